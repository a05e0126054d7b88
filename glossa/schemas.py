"""Table schemas, as DDL strings that readers accept."""

REQUESTS = ("request_id string, text string, lang string, content_type string")
TEXT_ITEMS = (
    "doc_id bigint, page_no int, item_ix int, str string, dir string, font_name string, "
    "has_eol boolean, width double, height double, transform array<double>"
)
PAGE_VIEWS = (
    "doc_id bigint, page_no int, width double, height double, rotation int, "
    "transform array<double>, view_box array<double>"
)
FONT_STYLES = (
    "doc_id bigint, font_name string, ascent double, descent double, family string, weight string, style string"
)
JOB_EVENTS = (
    "event_id bigint, ts timestamp, job_id string, batch_id string, event_type string, progress double"
)
STREAM_CHUNKS = ("request_id string, seq int, ts timestamp, chunk string")
TRANSLATIONS = ("doc_id bigint, block_id string, seq bigint, target string, is_final boolean")
IMAGE_REGIONS = (
    "region_id bigint, left double, top double, width double, height double, "
    "viewport_width double, viewport_height double, bitmap_width double, bitmap_height double"
)
