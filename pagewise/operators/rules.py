"""Rule-based false-positive removal for heading candidates.

Each rule is a Column predicate (true = keep), so the whole rule set is one
filter fused into the scan's code-generated stage.  Python ``re.match`` is
anchored at the start, so the patterns are wrapped in ``^(?:...)``; Python's
``\\d``/``\\s``/``\\S`` are Unicode, spelled out with explicit classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.functions.text import DIGIT, NON_WS_CLASS, WS_CLASS

D, S = DIGIT, WS_CLASS

# Month-name prefixes of the date rule.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
# Bullet characters (followed by whitespace).
BULLETS = "•\\-\\*\\+◦◆◇○●■□▪▫"

# Thresholds of the rules.
MAX_PUNCT_SHARE = 0.4
MAX_HEADING_WORDS = 15
MAX_DIGIT_RUNS = 2
MARGIN_SHARE = 0.1
MIN_HEADER_PAGES = 3

DATE_PREFIX = rf"(?i)^(?:{D}{{1,2}}[/\-]{D}{{1,2}}[/\-]{D}{{2,4}}|(?:{MONTHS})[a-z]*{S}+{D}{{1,2}},?{S}+{D}{{4}})"
FOOTER_PREFIX = rf"(?i)^(?:page{S}*{D}+|{D}+{S}+{D}+{S}+{D}+{S}+{D}+\n?\z|version|copyright)"
NUMBER_RUN = rf"^{D}+(?:{S}+{D}+)+\n?\z"
BULLET_PREFIX = rf"^[{BULLETS}]{S}+"
SHORT_ALPHA = r"^[A-Za-z]{1,2}\z"
TABLE_COLUMNS = rf"{NON_WS_CLASS} {{2,}}{NON_WS_CLASS}"
DIGIT_RUN = rf"{D}+"


def keep_punct(col="percent_punct"):
    return F.col(col) < MAX_PUNCT_SHARE


def not_date(t):
    return ~t.rlike(DATE_PREFIX)


def not_footer(t):
    return ~t.rlike(FOOTER_PREFIX)


def not_number_run(t):
    return ~t.rlike(NUMBER_RUN)


def not_bullet(t):
    return ~t.rlike(BULLET_PREFIX)


def not_short_alpha(t):
    return ~t.rlike(SHORT_ALPHA)


def not_table_row(t):
    return ~(t.rlike(TABLE_COLUMNS) & (F.regexp_count(t, F.lit(DIGIT_RUN)) > MAX_DIGIT_RUNS))


def keep_short(col="num_words"):
    return F.col(col) <= MAX_HEADING_WORDS


def heading_rule_mask(text_col: str = "text"):
    """Conjunction of all rules; true = keep the candidate."""
    t = F.col(text_col)
    return (keep_punct() & not_date(t) & not_footer(t) & not_number_run(t) & not_bullet(t)
            & not_short_alpha(t) & not_table_row(t) & keep_short())


def apply_heading_rules(cands: DataFrame, text_col: str = "text") -> DataFrame:
    return cands.where(heading_rule_mask(text_col))


def margin_blocks(feats: DataFrame) -> DataFrame:
    """Blocks in the top or bottom tenth of the page (strict)."""
    return feats.where((F.col("norm_y") < MARGIN_SHARE) | (F.col("norm_y") > 1 - MARGIN_SHARE))


def running_headers(feats: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts in the page margins on more than three distinct pages of a
    document.  Two aggregations, both with map-side combine: distinct
    (doc, text, page) first, then a count per (doc, text)."""
    pages = margin_blocks(feats).select(key, "text", "page_num").distinct()
    return (pages.groupBy(key, "text").agg(F.count(F.lit(1)).alias("n_pages"))
            .where(F.col("n_pages") > MIN_HEADER_PAGES))


def drop_running_headers(cands: DataFrame, headers: DataFrame, key: str = "doc_id") -> DataFrame:
    """Remove candidates whose exact text is a running header of their
    document (left anti join on (doc, text))."""
    return cands.join(headers.select(key, "text"), on=[key, "text"], how="left_anti")
