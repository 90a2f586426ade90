"""Words, stems, sentences and small string functions as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafline.plans.columns import let

# The stop words of the retrieval functions.
STOP_WORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can can't cannot could couldn't did didn't do does "
    "doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i "
    "i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same "
    "shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this "
    "those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with won't "
    "would wouldn't you you'd you'll you're you've your yours yourself yourselves also may shall will must within upon per via etc e.g i.e"
).split(" ")
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"


def cut(x: Column, k: int) -> Column:
    return F.substr(x, F.lit(1), F.length(x) - k)


def without_plural(w: Column) -> Column:
    hissing = reduce(or_, (w.endswith(e) for e in ("ses", "xes", "zes", "ches", "shes")))
    longer = F.when((F.length(w) > 5) & w.endswith("ies"), F.concat(cut(w, 3), F.lit("y"))).when((F.length(w) > 4) & hissing, cut(w, 2)).when((F.length(w) > 3) & ~w.endswith("ss"), cut(w, 1)).otherwise(w)
    return F.when(w.endswith("s"), longer).otherwise(w)


def without_ending(w: Column) -> Column:
    return F.when((F.length(w) > 6) & w.endswith("ing"), cut(w, 3)).when((F.length(w) > 5) & w.endswith("ed"), cut(w, 2)).otherwise(w)


def stem(w: Column) -> Column:
    """Plural endings, then -ing or -ed; of a word in lower case."""
    return let(without_plural(w), without_ending)


def tokens(text: Column) -> Column:
    """Words in lower case without stop words and single letters."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})")), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def terms(text: Column) -> Column:
    # twice, so that the first result is bound before its ending is looked at
    return F.transform(F.transform(tokens(text), without_plural), without_ending)


STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"
#: The same in DuckDB: TOKENS of a text, STEM of a word.
TOKENS_SQL = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''’-]*'), lambda w: length(w) > 1 AND NOT list_contains(" + STOP_SQL.replace("{", "{{") + ", w))"
ONCE_SQL = "CASE WHEN length({0}) > 5 AND {0} LIKE '%ies' THEN {0}[1:-4] || 'y' WHEN length({0}) > 4 AND regexp_matches({0}, '(?:s|x|z|ch|sh)es$') THEN {0}[1:-3] WHEN length({0}) > 3 AND {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN {0}[1:-2] ELSE {0} END"
TWICE_SQL = "CASE WHEN length({0}) > 6 AND {0} LIKE '%ing' THEN {0}[1:-4] WHEN length({0}) > 5 AND {0} LIKE '%ed' THEN {0}[1:-3] ELSE {0} END"


def mask(x: Column) -> Column:
    """All but the outer two characters on either side as dots; short values whole."""
    n = F.length(x)
    dot = F.lit("•")
    return F.when(n <= 4, F.repeat(dot, n)).otherwise(F.concat(F.substring(x, 1, 2), F.repeat(dot, n - 4), F.substr(x, n - 1)))


def words_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(words / 230 + 0.5)).cast("int")


def slugify(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-|-$", "")


def file_stem(x: Column) -> Column:
    """The name without its last extension; document if nothing is left."""
    s = F.regexp_replace(x, r"\.[^.]*$", "")
    return F.when(F.trim(s) == "", "document").otherwise(s)


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape_markdown(x: Column) -> Column:
    return F.regexp_replace(x, r"([*_`\[\]#|])", r"\\$1")


def sheet_name(x: Column) -> Column:
    """Without the characters sheets can't have, at most 31 characters."""
    return F.substring(F.trim(F.regexp_replace(x, r"[\[\]:*?/\\]", " ")), 1, 31)


def share_code(x: Column) -> Column:
    """What follows the last #, letters and digits only, at most 12."""
    return F.substring(F.regexp_replace(F.lower(F.substring_index(x, "#", -1)), "[^a-z0-9]", ""), 1, 12)


def keyword_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, "[,;]"), lambda s: F.trim(s)), lambda s: s != "")


def luminance(x: Column) -> Column:
    """Of a #rrggbb colour, 0 to 1."""
    part = lambda i: F.conv(F.substring(x, i, 2), 16, 10).cast("double") / 255
    return 0.2126 * part(2) + 0.7152 * part(4) + 0.0722 * part(6)
