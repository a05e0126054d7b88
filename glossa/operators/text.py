"""Text preparation, language detection and admission checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa import limits
from glossa.functions import ordered
from glossa.functions.text import (
    SPACE,
    SPACE_BODY,
    code_points,
    count_class,
    is_blank,
    sha256_hex,
    trim_space,
    utf8_bytes,
    utf16_units,
    valid_chars,
)

# Character sets used to tell scripts apart (regex class bodies).
KANA = r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}"
CYRILLIC = r"\x{0400}-\x{052F}"
LATIN = r"\p{IsLatin}"
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
ASCII_SIGNS = r"\x00-\x40\x5B-\x60\x7B-\x7F"

# Characters that end or open a phrase, and scripts written
# without spaces.
SENTENCE_BREAK = r"[.!?;:\x{3002}\x{FF01}\x{FF1F}\x{FF1B}]"
SENTENCE_OR_LINE_END = r"[.!?\x{3002}\x{FF01}\x{FF1F}\n]"
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
CLOSING = (
    r"[,.;:!?%\])}\x{3001}\x{3002}\x{FF0C}\x{FF0E}\x{FF1A}\x{FF1B}\x{FF01}\x{FF1F}"
    r"\x{3009}\x{300B}\x{300D}\x{300F}\x{3011}]"
)
OPENING = r"[\[({\x{3008}\x{300A}\x{300C}\x{300E}\x{3010}]"

# Identifier and fingerprint formats.
IDENTIFIER = r"\A[A-Za-z0-9][A-Za-z0-9._:-]*\z"
FINGERPRINT = r"\A[0-9A-Fa-f]{64}\z"


def normalized(text: Column) -> Column:
    """NBSP to blank, no blanks before a newline, at most one empty line, trimmed."""
    out = F.replace(text, F.lit("\u00a0"), F.lit(" "))
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return trim_space(out)


def normalize_text(df: DataFrame, col: str = "text", out: str = "norm_text") -> DataFrame:
    return df.withColumn(out, normalized(F.col(col))).withColumn(
        "changed", ~F.col(out).eqNullSafe(F.col(col))
    )


def sanitized_item(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\u0000"), F.lit(""))
    return trim_space(F.regexp_replace(out, r"[\t\r\n\f\x0B ]+", " "))


def sanitize_items(items: DataFrame, col: str = "str") -> DataFrame:
    """Clean the text of glyph runs and drop the empty ones."""
    return items.withColumn(col, sanitized_item(F.col(col))).filter(F.col(col) != "")


def script_profile(df: DataFrame, col: str = "text") -> DataFrame:
    """Counts of kana, Cyrillic, Latin, Han and other letters.

    Latin letters and ASCII signs are stripped once; the other scripts are then
    counted on what is left, which for most texts is next to nothing.
    """
    t = F.col(col)
    rest = F.regexp_replace(t, f"[{LATIN}{ASCII_SIGNS}]+", "")
    known = KANA + CYRILLIC + LATIN + HAN
    r = F.col("_rest")
    return (
        df.withColumn("latin", count_class(t, LATIN))
        .withColumn("_rest", rest)
        .withColumn("kana", count_class(r, KANA))
        .withColumn("cyrillic", count_class(r, CYRILLIC))
        .withColumn("han", count_class(r, HAN))
        .withColumn("other_letters", count_class(F.regexp_replace(r, f"[{known}]+", ""), r"\p{L}"))
        .drop("_rest")
    )


def detect_language(profile: DataFrame, out: str = "detected") -> DataFrame:
    """ja / ru / en from a script profile, '' when none is certain."""
    kana, cyr, lat, han, oth = (
        F.col(c) for c in ("kana", "cyrillic", "latin", "han", "other_letters")
    )
    letters = kana + cyr + lat + han + oth
    japanese = (
        (kana > 0) & ((kana >= 2) | (han <= 8)) & ((kana + han) / F.greatest(letters, F.lit(1)) >= 0.6)
    )
    russian = (cyr > 0) & (cyr >= lat * 0.35) & (cyr >= han + oth)
    english = (lat > 0) & (kana == 0) & (cyr == 0) & (han == 0) & (oth == 0)
    return profile.withColumn(
        out, F.when(japanese, "ja").when(russian, "ru").when(english, "en").otherwise("")
    )


def language_audit(df: DataFrame) -> DataFrame:
    """Detected languages and the unroutable share per language, per source and overall.

    Rows are first reduced to one count per (lang, source, detected); the
    grouping sets then expand only that small table.
    """
    counts = df.groupBy("lang", "source", "detected").agg(F.count("*").alias("n"))
    sets = counts.groupingSets(
        [["lang"], ["source"], []], "lang", "source"
    ).agg(
        F.grouping("lang").alias("g_lang"),
        F.grouping("source").alias("g_source"),
        F.sum("n").alias("n_docs"),
        *[
            F.coalesce(F.sum(F.when(F.col("detected") == d, F.col("n"))), F.lit(0)).alias(f"n_{d}")
            for d in ("en", "ja", "ru")
        ],
        F.coalesce(F.sum(F.when(F.col("detected") == "", F.col("n"))), F.lit(0)).alias("n_unroutable"),
    )
    return sets.select(
        F.when(F.col("g_lang") == 0, "lang").when(F.col("g_source") == 0, "source").otherwise("all").alias("level"),
        F.when(F.col("g_lang") == 0, F.col("lang")).when(F.col("g_source") == 0, F.col("source")).otherwise("all").alias("name"),
        "n_docs",
        "n_en",
        "n_ja",
        "n_ru",
        "n_unroutable",
        (F.col("n_unroutable") / F.col("n_docs")).alias("unroutable_share"),
    )


def classify_content(df: DataFrame, col: str = "text", out: str = "content_type") -> DataFrame:
    """``word`` for up to three tokens in at most 80 units without sentence marks."""
    t = F.col(col)
    tokens = F.regexp_count(t, F.lit(f"[^{SPACE_BODY}]+"))
    # The length test comes first: long texts never reach the regexes.
    short = (F.length(t) <= 80) & (utf16_units(t) <= 80)
    word = short & ~F.rlike(t, F.lit(SENTENCE_OR_LINE_END)) & (tokens <= 3)
    return df.withColumn(out, F.when(word, "word").otherwise("paragraph"))


def validate_requests(
    df: DataFrame, max_chars: int = limits.MAX_TEXT_UNITS, col: str = "text"
) -> DataFrame:
    t = trim_space(F.col(col))
    return df.withColumn(
        "error_code",
        F.when(t.isNull() | (t == ""), "INVALID_TEXT").when(
            # Units lie between one and two per code point, so most texts are
            # decided by their length alone.
            (F.length(t) > max_chars) | ((F.length(t) * 2 > max_chars) & (utf16_units(t) > max_chars)),
            "TEXT_TOO_LONG",
        ),
    )


def is_identifier(col: Column, max_length: int = limits.MAX_IDENTIFIER_LENGTH) -> Column:
    return F.coalesce(
        (F.length(col) <= max_length) & F.rlike(col, F.lit(IDENTIFIER)), F.lit(False)
    )


def validate_batches(
    blocks: DataFrame,
    max_blocks: int = limits.MAX_BLOCKS_PER_BATCH,
    max_chars: int = limits.MAX_BATCH_CHARS,
    max_bytes: int = limits.MAX_BATCH_BYTES,
) -> DataFrame:
    """One verdict row per batch from ``batch_id, block_ix, block_id, text``.

    The code is that of the first offending block.  Batches above the block cap
    are settled from their counts alone; only batches within the cap (a bounded
    number of rows each) are examined block by block.
    """
    sizes = blocks.groupBy("batch_id").agg(
        F.count("*").alias("n_blocks"),
        F.sum(code_points(F.coalesce("text", F.lit("")))).alias("n_chars"),
        F.sum(utf8_bytes(F.coalesce("text", F.lit("")))).alias("n_bytes"),
    )
    over = sizes.filter(F.col("n_blocks") > max_blocks)
    within = blocks.join(over.select("batch_id"), ["batch_id"], "left_anti")

    seq = Window.partitionBy("batch_id").orderBy("block_ix")
    upto = seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same_id = Window.partitionBy("batch_id", "block_id").orderBy("block_ix")
    checked = (
        within.withColumn("_chars", code_points(F.coalesce("text", F.lit(""))))
        .withColumn("_bytes", utf8_bytes(F.coalesce("text", F.lit(""))))
        .withColumn("_blank", is_blank(F.col("text")))
        .withColumn("_bad_id", ~is_identifier(F.col("block_id")))
        .drop("text")
        .withColumn("_nth", F.row_number().over(same_id))
        .withColumn("_run_chars", F.sum("_chars").over(upto))
        .withColumn("_run_bytes", F.sum("_bytes").over(upto))
        .withColumn(
            "_code",
            F.when(F.col("_bad_id"), "BLOCK_ID_INVALID")
            .when(F.col("_nth") > 1, "DUPLICATE_BLOCK_ID")
            .when(F.col("_blank"), "BLOCK_TEXT_INVALID")
            .when(F.col("_run_chars") > max_chars, "BATCH_TEXT_TOO_LONG")
            .when(F.col("_run_bytes") > max_bytes, "BATCH_UTF8_TOO_LARGE"),
        )
    )
    verdicts = checked.groupBy("batch_id").agg(
        F.count("*").alias("n_blocks"),
        F.sum("_chars").alias("n_chars"),
        F.sum("_bytes").alias("n_bytes"),
        F.min_by("_code", F.when(F.col("_code").isNotNull(), F.col("block_ix"))).alias("error_code"),
    )
    refused = over.select(
        "batch_id",
        "n_blocks",
        "n_chars",
        "n_bytes",
        F.lit("BLOCKS_INVALID").alias("error_code"),
    )
    return verdicts.unionByName(refused)


def validate_jobs(jobs: DataFrame, max_pages: int = limits.MAX_PAGES) -> DataFrame:
    """Check ``job_id, fingerprint, page_count``; among valid rows of one job id
    only the first by ``seq`` is kept."""
    checked = jobs.withColumn(
        "_code",
        F.when(~is_identifier(F.col("job_id")), "JOB_ID_INVALID")
        .when(~F.coalesce(F.rlike("fingerprint", F.lit(FINGERPRINT)), F.lit(False)), "FINGERPRINT_INVALID")
        .when(~F.coalesce(F.col("page_count").between(1, max_pages), F.lit(False)), "PAGE_COUNT_INVALID"),
    ).withColumn("fingerprint", F.lower("fingerprint"))
    repeated = (
        checked.filter(F.col("_code").isNull())
        .groupBy("job_id")
        .agg(F.min("seq").alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .select("job_id", "_first")
    )
    joined = checked.join(repeated, ["job_id"], "left")
    return joined.withColumn(
        "error_code",
        F.coalesce("_code", F.when(F.col("seq") > F.col("_first"), "JOB_ALREADY_EXISTS")),
    ).drop("_code", "_first")


def rejection_summary(df: DataFrame, dims: tuple[str, ...] = ("error_code", "source", "lang")) -> DataFrame:
    """Counts of rejected rows by every combination of the dimensions, with totals.

    Counted once at the finest grain, then cubed, so the cube's row expansion
    never touches the input rows.
    """
    fine = df.filter(F.col(dims[0]).isNotNull()).groupBy(*dims).agg(F.count("*").alias("n"))
    cubed = fine.cube(*dims).agg(
        F.sum("n").alias("n_rows"), *[F.grouping(d).alias(f"_g_{d}") for d in dims]
    )
    return cubed.select(
        *[F.when(F.col(f"_g_{d}") == 1, "*").otherwise(F.col(d)).alias(d) for d in dims], "n_rows"
    )


def fingerprint_dedup(df: DataFrame, id_col: str = "doc_id", col: str = "text") -> DataFrame:
    """Mark one representative per content hash; copies carry the group size."""
    hashed = df.withColumn("fingerprint", sha256_hex(F.col(col)))
    groups = (
        hashed.groupBy("fingerprint")
        .agg(F.min(id_col).alias("_rep"), F.count("*").alias("_n"))
        .filter("_n > 1")
    )
    joined = hashed.join(groups, ["fingerprint"], "left")
    return (
        joined.withColumn("representative", F.coalesce("_rep", F.col(id_col)))
        .withColumn("group_size", F.coalesce("_n", F.lit(1)).cast("bigint"))
        .withColumn("is_representative", F.col("representative") == F.col(id_col))
        .drop("_rep", "_n")
    )


def suppress_repeats(
    requests: DataFrame, segment_seconds: int = 86_400, tiebreak: str = "event_id"
) -> DataFrame:
    """Drop a request equal to the previous one (``lang:text``) of the same user.

    Needs ``user_id, ts, lang, text`` and a unique ``tiebreak``.  An optional
    boolean ``still_open`` restricts the rule to rows where it is true.
    """
    keyed = requests.withColumn("_key", F.concat_ws(":", "lang", "text"))
    lagged = ordered.previous_row(
        keyed, ["user_id"], ["ts", tiebreak], ordered.time_segment(F.col("ts"), segment_seconds), ["_key"]
    )
    same = F.col("_key").eqNullSafe(F.col("prev__key"))
    if "still_open" in requests.columns:
        same = same & F.coalesce("still_open", F.lit(False))
    return lagged.filter(~same).drop("_key", "prev__key")


def chunk_pattern(limit: int) -> str:
    """Regex that cuts a text at the last boundary in [0.55 * limit, limit].

    Fixed value: the 55 % minimum fill.
    """
    lo = int(limit * 0.55)
    more = f"(?=.{{{limit + 1}}})"
    return (
        f"(?s){more}.{{{max(lo - 1, 0)},{limit - 1}}}(?:{SPACE}|{SENTENCE_BREAK}(?={SPACE})){SPACE}*"
        f"|{more}.{{{limit}}}{SPACE}*"
        f"|.{{1,{limit}}}"
    )


def chunks_of(text: Column, limit: int) -> Column:
    """Array of trimmed chunks of at most ``limit`` code points."""
    whole = F.array(trim_space(text))
    cut = F.transform(
        F.regexp_extract_all(text, F.lit(chunk_pattern(limit)), F.lit(0)), trim_space
    )
    parts = F.when(F.length(text) <= limit, whole).otherwise(cut)
    return F.filter(parts, lambda c: c != "")


def chunk_text(df: DataFrame, limit: int = limits.MAX_BATCH_CHARS, col: str = "text") -> DataFrame:
    """One row per chunk, with continuation index and count."""
    return (
        df.withColumn("_parts", chunks_of(F.col(col), limit))
        .withColumn("continuation_count", F.size("_parts").cast("bigint"))
        .select(
            *[c for c in df.columns if c != col],
            "continuation_count",
            F.posexplode("_parts").alias("continuation_ix", "chunk"),
        )
        .withColumn("continuation_ix", F.col("continuation_ix").cast("bigint"))
        .withColumn("n_chars", code_points(F.col("chunk")))
    )


def needs_hyphen_join(left: Column, right: Column) -> Column:
    return F.rlike(F.right(left, F.lit(2)), F.lit(r"\p{L}-\z")) & F.rlike(
        F.left(right, F.lit(1)), F.lit(r"\p{Ll}")
    )


def joins_without_space(left: Column, right: Column) -> Column:
    end, start = F.right(left, F.lit(1)), F.left(right, F.lit(1))
    return (
        F.rlike(start, F.lit(CLOSING))
        | F.rlike(end, F.lit(OPENING))
        | (F.rlike(end, F.lit(UNSPACED)) & F.rlike(start, F.lit(UNSPACED)))
    )


def joined_lines(lines: Column) -> Column:
    """Rejoin hard-wrapped lines into running text.

    Whether two lines meet with a hyphen, a blank or nothing depends only on the
    end of the left line and the start of the right one, so each non-empty line
    is rendered with its own joint and the pieces are concatenated once
    (linear in the text, unlike a growing accumulator).
    """
    full = F.filter(lines, lambda x: x != "")

    def piece(x: Column, nxt: Column) -> Column:
        return (
            F.when(nxt.isNull(), x)
            .when(needs_hyphen_join(x, nxt), F.substring(x, F.lit(1), F.length(x) - 1))
            .when(joins_without_space(x, nxt), x)
            .otherwise(F.concat(x, F.lit(" ")))
        )

    # zip_with pads the shorter side with null: the last line has no successor.
    following = F.slice(full, F.lit(2), F.size(full))
    return F.array_join(F.zip_with(full, following, piece), "")


def unwrap_lines(df: DataFrame, col: str = "text", out: str = "unwrapped") -> DataFrame:
    lines = F.transform(F.split(F.col(col), "\n"), trim_space)
    return df.withColumn(out, joined_lines(lines))


def count_valid_chars(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("valid_chars", valid_chars(F.col(col)))


def routable_share(documents: DataFrame, max_chars: int = limits.MAX_TEXT_UNITS) -> DataFrame:
    """Share of routable text by declared language and source, with rejects."""
    prepared = reduce(
        lambda d, step: step(d),
        [
            lambda d: normalize_text(d, "text", "norm_text"),
            lambda d: script_profile(d, "norm_text"),
            detect_language,
            lambda d: validate_requests(d, max_chars, "norm_text"),
        ],
        documents,
    )
    ok = F.col("error_code").isNull() & (F.col("detected") != "")
    return prepared.groupBy("lang", "source").agg(
        F.count("*").alias("n_docs"),
        F.count_if(ok).alias("n_routable"),
        F.count_if(F.col("error_code") == "INVALID_TEXT").alias("n_invalid"),
        F.count_if(F.col("error_code") == "TEXT_TOO_LONG").alias("n_too_long"),
        F.count_if(F.col("error_code").isNull() & (F.col("detected") == "")).alias("n_unknown_language"),
        F.coalesce(F.sum(F.when(ok, F.length("norm_text"))), F.lit(0)).cast("bigint").alias("routable_chars"),
        (F.count_if(ok) / F.count("*")).alias("routable_share"),
    )
