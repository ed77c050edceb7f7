"""Boilerplate lines by site-relative frequency.

A line is boilerplate on a host if more than ``ratio`` of the host's pages contain it. Everything is
DataFrame work: each page gives its distinct line hashes once, counting is pre-aggregated in every task, and
a host with many pages is dealt to as many tasks as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable.llm.common import fresh, text_key, written
from wavetable.llm.minhash import PERCENT, components

#: A line of one page alone is never boilerplate, or a host of one page would lose all its lines.
RATIO, MIN_PAGES = 0.1, 2
#: A host with more pages than this, and than one in HOSTS of all pages, is dealt to several tasks.
HOST_PAGES, HOSTS = 1000, 1 << 16
BLANKS = " \t\r"
#: Near copies: texts that share PERCENT of their WIDTH-word shingles; such a pair shares none of the bands with 6e-4.
WIDTH, BANDS, ROWS = 5, 14, 4


def line_key(line: Column) -> Column:
    """128 bits of a line without outer blanks."""
    line = F.btrim(line, F.lit(BLANKS))
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def visible(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def host_key(host: Column) -> Column:
    """A null host is a host of its own."""
    return F.when(host.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), host.cast("string")))


def line_keys(text: Column) -> Column:
    """Keys of the distinct visible lines of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n", -1), visible), line_key))


def large_hosts(totals: DataFrame) -> DataFrame:
    """(host, parts) of the hosts that are dealt to several tasks; at most HOSTS rows, however many hosts there are."""
    totals = totals.groupBy("host").agg(F.sum("pages").alias("pages"))
    whole = totals.agg(F.sum("pages")).first()[0] or 0
    most = max(HOST_PAGES, whole // HOSTS)
    rows = totals.filter(F.col("pages") > most).select("host", F.ceil(F.col("pages") / most).cast("long").alias("parts")).collect()
    return F.broadcast(totals.sparkSession.createDataFrame(rows, "host string, parts long"))


def dealt(df: DataFrame, large: DataFrame, key: Column, salt: str = "salt") -> DataFrame:
    """Add ``salt``: the part of its host that a row goes to, by ``key``."""
    return df.join(large, "host", "left").withColumn(salt, F.pmod(key, F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")


def copied(df: DataFrame, large: DataFrame, salt: str = "salt") -> DataFrame:
    """Every row once for each part of its host."""
    parts = F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)
    return df.join(large, "host", "left").withColumn(salt, F.explode(parts)).drop("parts")


def frequent(lines: DataFrame, totals: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, a, b) of the ``lines`` (host, line) that more than ``ratio`` of the host's pages (host, pages) hold, and ``min_pages`` at least."""
    counted = lines.groupBy("host", F.col("line.a").alias("a"), F.col("line.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    large = large_hosts(totals)
    counted = dealt(counted.filter(F.col("n") >= min_pages), large, F.col("a"))
    return counted.join(copied(totals, large), ["host", "salt"]).filter(F.col("n") > F.col("pages") * F.lit(ratio)).select("host", "a", "b")


def by_host(lines: DataFrame) -> DataFrame:
    return lines.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("lines"))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): keys of the boilerplate lines of each host that has some.

    A line occurs in a page once however often it is repeated there; repeated rows are pages of their own.
    Blank lines don't count. The lines of a host number at most its mean number of lines a page divided by
    ``ratio``, so the arrays are bounded. Lines on fewer than ``min_pages`` pages of a host are kept.
    """
    counted = pages.select(host_key(host).alias("host"), F.explode(line_keys(text)).alias("line"))
    totals = pages.groupBy(host_key(host).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    return by_host(frequent(counted, totals, ratio, min_pages))


def near_copies(texts: DataFrame) -> DataFrame:
    """(key, group) of the ``texts`` (key, text) that have a near copy; the members of a bucket meet one of them, drawn for each bucket."""
    parts = F.filter(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    hashed = written(texts.select("key", F.transform(parts, lambda w: F.xxhash64(w)).alias("words")).filter(F.size("words") > 0))
    first = F.sequence(F.lit(1), F.greatest(F.size("words") - WIDTH + 1, F.lit(1)))
    sets = written(hashed.select("key", F.array_distinct(F.transform(first, lambda k: F.xxhash64(F.slice("words", k, WIDTH)))).alias("shingles")))
    least = [F.array_min(F.transform("shingles", lambda x, k=k: F.xxhash64(x, F.lit(k)))) for k in range(BANDS * ROWS)]
    bands = F.array(*[F.xxhash64(F.lit(k), *least[k * ROWS : (k + 1) * ROWS]) for k in range(BANDS)])
    members = written(sets.select("key", F.explode(bands).alias("band")))
    centres = members.groupBy("band").agg(F.min_by("key", F.xxhash64("key", "band")).alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = members.join(centres, "band").filter("key <> centre").select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct()
    x, y = (sets.select(F.col("key").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    close = pairs.join(x, "a").join(y, "b").filter(100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both))
    return components(close.select("a", "b")).select(F.col("id").alias("key"), F.col("component").alias("group"))


def boilerplate_of_distinct(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The same with exact and near copies as one page of their host, in the counts of lines and of pages alike.

    A line has to be frequent twice: among the distinct texts of a host, and among those that hold more than
    frequent lines, with near copies as one. So copies never make their own lines boilerplate, however many
    there are, and a text gets empty only if others with a text of their own hold all its lines.
    """
    rows = pages.select(host_key(host).alias("host"), text_key(text).alias("key"), text.cast("string").alias("text"))
    texts = written(rows.select("host", "key", line_keys(F.col("text")).alias("lines")).groupBy("host", "key").agg(F.first("lines").alias("lines")))
    of = lambda t: t.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    often = written(frequent(texts.select("host", F.explode("lines").alias("line")), of(texts), ratio, min_pages))
    if often.isEmpty():
        return by_host(often)
    lines = texts.select("host", "key", F.size("lines").alias("all"), F.explode("lines").alias("line"))
    held = written(lines.select("*", "line.a", "line.b").join(often, ["host", "a", "b"], "left_semi").select("host", "key", "all", "line"))
    whole = held.groupBy("host", "key", "all").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.col("all")).select("host", "key")
    held, others = (t.join(whole, ["host", "key"], "left_anti") for t in (held, texts.select("host", "key")))
    suspects = rows.select("key", "text").dropDuplicates(["key"]).join(held.select("key").distinct(), "key", "left_semi")
    groups = near_copies(suspects)
    one = lambda t, *also: t.join(groups, "key", "left").select("host", F.coalesce("group", "key").alias("group"), *also).distinct()
    return by_host(frequent(one(held, "line"), of(one(others)), ratio, min_pages))


def drop_boilerplate(
    pages: DataFrame, host_col: str = "host", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, dropped: str | None = None,
    copies_once: bool = False,
) -> DataFrame:
    """``pages`` with their text cut by the boilerplate lines; ``dropped`` names a column for their number.

    All rows and columns stay, in their order; a null text stays null, a text of boilerplate alone gets
    empty. Lines are compared without outer blanks and kept as they are. With ``copies_once`` the exact and
    near copies of a text count as one page, so that they don't make each other's lines boilerplate.
    """
    names = pages.columns
    few, hit = (fresh(*names, base=b) for b in ("bad_lines", "hit_lines"))
    find = boilerplate_of_distinct if copies_once else boilerplate
    bad = find(pages, F.col(host_col), F.col(text_col), ratio, min_pages)
    totals = pages.groupBy(host_key(F.col(host_col)).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    large = large_hosts(totals)
    # the row is one struct, so that its names can't clash with those of the join
    rows = pages.select(F.struct(*[F.col(c) for c in names]).alias("row"), host_key(F.col(host_col)).alias("host"))
    text = F.col("row").getField(text_col)
    joined = dealt(rows, large, F.xxhash64(text, *[F.col("row").getField(c).cast("string") for c in names[:1]])).join(copied(bad, large), ["host", "salt"], "left")
    # hashed lookup of all lines of the page by half their key; the whole key is compared with those few that it hits
    found = F.array_intersect(F.transform(F.filter(F.split(text, "\n", -1), visible), lambda x: line_key(x)["a"]), F.col("lines.a"))
    joined = joined.withColumn(hit, found)
    joined = joined.select("row.*", F.when(F.size(hit) > 0, F.filter("lines", lambda x: F.array_contains(F.col(hit), x["a"]))).alias(few))
    text, lines = F.col(text_col), few
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~(visible(x) & F.array_contains(F.col(lines), line_key(x))))
    clean = F.when(F.col(lines).isNull() | text.isNull(), text).otherwise(F.array_join(kept, "\n"))
    extra = []
    if dropped:
        gone = F.when(F.col(lines).isNull() | text.isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n", -1)) - F.size(kept))
        extra = [gone.cast("long").alias(dropped)]
    return joined.select(*[clean.alias(c) if c == text_col else F.col(c) for c in names], *extra)


#: Tags that begin a line, and parts that hold no text.
BLOCKS = "(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|nav|article|header|footer|section|table|tr|td|title|body|html)(?:[\\s/][^>]*)?>"
HIDDEN = ("(?s)<!--.*?-->", "(?is)<script.*?</script>", "(?is)<style.*?</style>")
TAG, HOST = "<[^>]*>", "^[a-z][a-z0-9+.-]*://([^/?#:]+)"


def page_text(html: Column) -> Column:
    """Text of a page: hidden parts go, block tags begin lines, other tags go, blank lines go."""
    for pattern in HIDDEN:
        html = F.regexp_replace(html, pattern, "")
    plain = F.regexp_replace(F.regexp_replace(html, BLOCKS, "\n"), TAG, "")
    return F.array_join(F.filter(F.split(plain, "\n", -1), visible), "\n")


def page_host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), HOST, 1)
