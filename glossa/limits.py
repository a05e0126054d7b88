"""Default limits.  All of them are parameters of the operators that use them."""

# Admission limits for texts, batches and jobs.
MAX_TEXT_UNITS = 20_000
MAX_BATCH_CHARS = 20_000
MAX_BATCH_BYTES = 80 * 1024
MAX_BLOCKS_PER_BATCH = 1
MAX_IDENTIFIER_LENGTH = 100
MAX_PAGES = 500
MAX_JOB_BATCHES = 2_000
MAX_JOB_CHARS = 10_000_000
MAX_JOB_BYTES = 32 * 1024 * 1024
MAX_QUEUED_BATCHES = 64
MAX_ACTIVE_BATCHES = 10
MAX_ACTIVE_JOBS = 4
MAX_FILE_BYTES = 200 * 1024 * 1024
MAX_PAGE_SIDE = 20_000
SIGNATURE_WINDOW = 1_024

# Response limits.
MAX_RESPONSE_CHARS = 1_000_000
MAX_STREAM_BYTES = 8 * 1024 * 1024
MAX_REMAINDER_UNITS = 256 * 1024
HEADER_TIMEOUT_S = 60
FIRST_CONTENT_TIMEOUT_S = 120
IDLE_TIMEOUT_S = 45
TOTAL_TIMEOUT_S = 180

# Page verdict and image limits.
MIN_VALID_CHARS = 12
MIN_TEXT_COVERAGE = 0.00025
MAX_IMAGE_SIDE = 2_048
MAX_IMAGE_PIXELS = 3_200_000
MAX_IMAGE_BYTES = 3 * 1024 * 1024
IMAGE_QUALITIES = (0.9, 0.82, 0.74, 0.66)
MIN_REGION_SIDE = 12
MAX_VIEWPORT_SIDE = 100_000
