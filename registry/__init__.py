"""Registered queries and the SQL that restates each of them."""

from registry import batches, images, jobs, layout, streams, text

MODULES = [text, batches, jobs, streams, images, layout]
