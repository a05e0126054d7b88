"""Response streams, timers and interactive request rules; batch and streaming."""
