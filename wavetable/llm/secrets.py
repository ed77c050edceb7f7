"""Secret scan with corpus-wide ownership frequency.

Candidates are found by fixed patterns, hashed, and counted over the whole corpus by distinct repositories and
owners. A value that several owners hold, or one owner in many repositories, is a widely copied example; a value of
one owner in few repositories looks live. Beside the fixed kinds there are opaque tokens, which are reported only if
they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable.llm.common import written

# The kinds in their order, pattern, group that holds the value, least length of the value.
KINDS = (
    ("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", "([0-9a-f]{24,})", 1, 24),
)
#: Long runs with lower case, upper case and digits.
OPAQUE = ("opaque", "(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{24,})", 1, 24)
#: More owners or repositories than this make a value an example.
LIVE_OWNERS, LIVE_REPOS = 1, 2
#: Matches whose positions are summed up in one go, see ``matches``.
RUN = 256
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def matches(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches whose value is long enough, as SPAN; code points, end exclusive.

    The text between matches comes from split, so positions are running sums of lengths. They are summed in runs of
    ``RUN`` matches: appending copies a list, so one list of all matches would take the square of their number.
    """
    whole, value, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    parts = F.arrays_zip(whole.alias("whole"), value.alias("value"), F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"))

    def step(seen: Column, x: Column) -> Column:
        start = seen["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["whole"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(seen["spans"], F.array(span)).alias("spans"))

    def length(total: Column, x: Column) -> Column:
        return total + F.char_length(x["gap"]) + F.char_length(x["whole"])

    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int")),
        lambda k: F.slice(parts, k * RUN + 1, F.lit(RUN)),
    )

    def run(seen: Column, x: Column) -> Column:
        spans = F.aggregate(x, F.struct(seen["at"].alias("at"), F.array().cast(SPAN).alias("spans")), step)["spans"]
        return F.struct(F.aggregate(x, seen["at"], length).alias("at"), F.concat(seen["runs"], F.array(spans)).alias("runs"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("runs"))
    found = F.filter(F.flatten(F.aggregate(runs, begin, run)["runs"]), lambda x: F.char_length(x["value"]) >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def candidates(text: Column) -> Column:
    base = [matches(text, k, *spec[1:]) for k, spec in enumerate(KINDS)]
    opaque = F.filter(
        matches(text, len(KINDS), *OPAQUE[1:]),
        lambda x: x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[0-9]"),
    )
    return F.array_sort(F.concat(*base, opaque))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in (*KINDS, OPAQUE)])
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])
    return F.array_join(F.transform(spans, one), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """(id, base, added, n_live, n_example, most_owners, most_repos): spans of the fixed kinds and of live-looking opaque tokens.

    A span is (start, kind, end, value). A value is live if one owner alone holds it, in at most ``LIVE_REPOS`` of its
    repositories (``repo_col``; without it, an owner is one repository); ``most_owners`` and ``most_repos`` are those of a document's
    most widely held value, 0 without values. Every row is a document of its own, repeated rows too; a null or empty
    text has no spans; a null owner or repository is one of its own; no rows give no rows. Counting goes over distinct
    (value, owner, repository), so a value that a third of the corpus holds shrinks in every task before the
    shuffle. Other columns are not carried on.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    rows = written(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            named(owner_col).alias("owner"),
            (named(repo_col) if repo_col else F.lit("")).alias("repo"),
            candidates(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("spans"),
        )
    )
    value = F.col("span.value")
    spans = rows.filter(F.size("spans") > 0).select("row", "owner", "repo", F.explode("spans").alias("span"))
    spans = spans.withColumns({"a": F.xxhash64(value), "b": F.xxhash64(F.lit("value"), value)})
    by_owner = spans.select("a", "b", "owner", "repo").distinct().groupBy("a", "b", "owner").agg(F.count(F.lit(1)).alias("repos"))
    held = by_owner.groupBy("a", "b").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))
    live = (F.col("owners") <= LIVE_OWNERS) & (F.col("repos") <= LIVE_REPOS)
    judged = spans.select("row", "span", "a", "b").join(held, ["a", "b"]).withColumn("live", live)
    extra = judged.groupBy("row").agg(
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
        F.max("owners").alias("most_owners"),
        F.max("repos").alias("most_repos"),
        F.array_sort(F.collect_list(F.when(F.col("live") & (F.col("span.kind") == len(KINDS)), F.col("span")))).alias("added"),
    )
    base = F.filter("spans", lambda x: x["kind"] < len(KINDS))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_example", "most_owners", "most_repos")]
    found = rows.select("row", "id", base.alias("base")).join(extra, "row", "left")
    return found.select(F.col("id").alias(id_col), "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"), *counts)
