"""Scanned-code normalising (F8, F9) as one JVM-side column expression.

Steps, first match wins: trim; percent-decode (a bad escape keeps the text,
'+' stays '+'); for an http(s) link take the ``member`` query value
(form-decoded) or else the last path segment; keep a version 1-5 UUID as is;
otherwise drop blanks and dashes and take a 13-digit, then a 12-digit run
standing alone; else the stripped text. Empty codes match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns. Blank characters are those of the ECMAScript \s class.
JS_BLANK = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
UUID_RE = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
LINK_RE = r"(?i)^https?://"
DIGITS13 = r"(?<![A-Za-z0-9_])([0-9]{13})(?![A-Za-z0-9_])"
DIGITS12 = r"(?<![A-Za-z0-9_])([0-9]{12})(?![A-Za-z0-9_])"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{JS_BLANK}+|{JS_BLANK}+$", "")


def strip_blanks_dashes(c: Column) -> Column:
    return F.regexp_replace(c, f"{JS_BLANK}+|-", "")


def is_uuid(c: Column) -> Column:
    return c.rlike(UUID_RE)


def _keep_uuid_or_strip(c: Column) -> Column:
    return F.when(is_uuid(c), c).otherwise(strip_blanks_dashes(c))


# Characters a browser URL parser percent-encodes but java.net.URI rejects.
URL_ESCAPES = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "`": "%60", "{": "%7B",
               "}": "%7D", "|": "%7C", "^": "%5E", "\\": "%5C"}


def _url_safe(c: Column) -> Column:
    for ch, enc in URL_ESCAPES.items():
        c = F.replace(c, F.lit(ch), F.lit(enc))
    return c


def with_code(df: DataFrame, raw: str, out: str = "code") -> DataFrame:
    """Add the normalised member code of column ``raw`` as ``out`` ('' when
    nothing usable is left). Staged as successive projections so each
    intermediate (trimmed, decoded, parsed) is computed once per row; Catalyst
    does not collapse projections that would repeat an expensive expression."""
    s0 = js_trim(F.coalesce(F.col(raw), F.lit("")))
    staged = (
        df.withColumn("_c_s0", s0)
        # decodeURIComponent keeps '+', and a malformed escape leaves the text unchanged
        .withColumn("_c_s", F.coalesce(F.try_url_decode(F.replace(F.col("_c_s0"), F.lit("+"), F.lit("%2B"))),
                                       F.col("_c_s0")))
        .withColumn("_c_link", F.col("_c_s").rlike(LINK_RE))
        .withColumn("_c_url", F.when(F.col("_c_link"), _url_safe(F.col("_c_s"))))
        .withColumn("_c_mraw", F.try_parse_url(F.col("_c_url"), F.lit("QUERY"), F.lit("member")))
        .withColumn("_c_path", F.try_parse_url(F.col("_c_url"), F.lit("PATH")))
        .withColumn("_c_member", js_trim(F.coalesce(F.try_url_decode(F.col("_c_mraw")), F.col("_c_mraw"),
                                                    F.lit(""))))
        .withColumn("_c_last", js_trim(F.coalesce(
            F.try_element_at(F.filter(F.split(F.coalesce(F.col("_c_path"), F.lit("")), "/"),
                                      lambda x: x != ""), F.lit(-1)),
            F.lit(""))))
        .withColumn("_c_strip", strip_blanks_dashes(F.col("_c_s")))
        .withColumn("_c_m13", F.regexp_extract(F.col("_c_strip"), DIGITS13, 1))
        .withColumn("_c_m12", F.regexp_extract(F.col("_c_strip"), DIGITS12, 1))
    )
    link, member, last, s = F.col("_c_link"), F.col("_c_member"), F.col("_c_last"), F.col("_c_s")
    plain = (F.when(is_uuid(s), s)
             .when(F.col("_c_m13") != "", F.col("_c_m13"))
             .when(F.col("_c_m12") != "", F.col("_c_m12"))
             .otherwise(F.col("_c_strip")))
    code = (F.when(link & (member != ""), _keep_uuid_or_strip(member))
            .when(link & F.col("_c_path").isNotNull() & (last != ""), _keep_uuid_or_strip(last))
            .otherwise(plain))
    return staged.withColumn(out, code).drop(*[c for c in staged.columns if c.startswith("_c_")])
