"""Registered queries of the text operators, each beside its SQL twin where SQL can express it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetable.llm import chat, decontamination, filter_audit, line_dedup, merkle, minhash, packing, quality_classifier, quality_rules, secrets, sharding, suffix_dedup, window_packing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op1_best_fit_packing(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), byte_bpe())


LINES = r"""
with plain as (
    select page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1) as host,
        string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
            '<!--.*?-->', '', 'gs'), '<script.*?</script>', '', 'gsi'), '<style.*?</style>', '', 'gsi'),
            '</?(?:p|div|br|li|ul|ol|h[1-6]|nav|article|header|footer|section|table|tr|td|title|body|html)(?:[\s/][^>]*)?>', chr(10), 'gi'),
            '<[^>]*>', '', 'g'), chr(10)) as parts
    from pages),
lines as (
    select page_id, host, list_filter(parts, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '') as parts from plain),
each as (
    select page_id, host, unnest(parts) as line, generate_subscripts(parts, 1) as k from lines),
often as (
    select host, line from (
        select host, trim(line, ' ' || chr(9) || chr(13)) as line, count(distinct page_id) as n from each group by all)
    join (select host, count(*) as total from lines group by host) using (host)
    where n >= 2 and n > total * 0.1),
marked as (
    select e.*, o.line is not null as bad
    from each e left join often o on o.host = e.host and o.line = trim(e.line, ' ' || chr(9) || chr(13)))
select l.page_id, l.host, coalesce(any_value(len(l.parts)), 0)::bigint as n_lines,
    count(*) filter (where bad)::bigint as n_dropped,
    coalesce(string_agg(m.line, chr(10) order by m.k) filter (where not bad), '') as text
from lines l left join marked m using (page_id)
group by l.page_id, l.host
"""


@query(LINES)
def op2_line_dedup(spark, folder):
    pages = table(spark, folder, "pages").select(
        "page_id", line_dedup.page_host(F.col("url")).alias("host"), line_dedup.page_text(F.col("html")).alias("text")
    )
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1)))
    clean = line_dedup.drop_boilerplate(pages.withColumn("n_lines", lines.cast("long")), dropped="n_dropped")
    return clean.select("page_id", "host", "n_lines", "n_dropped", "text")


@query()
def op3_minhash(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents"), width=2)


def read_chats(batches):
    """Digests of formatted conversations, from the formatted text and the token mask alone."""
    digest = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        rows = batch.to_pydict()
        turns = [chat.read_back(f) for f in rows["formatted"]]
        losses = [chat.loss_text(*x) for x in zip(rows["formatted"], rows["starts"], rows["ends"], rows["mask"])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(t) for t in turns], pa.int64()),
                pa.array([digest("".join(f"{role or ''}\n{text}\n" for role, text in t)) for t in turns]),
                pa.array([len(x) for x in losses], pa.int64()),
                pa.array([digest(x) for x in losses]),
                pa.array([len(f) for f in rows["formatted"]], pa.int64()),
            ],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


@query()
def op4_chat_format(spark, folder):
    says = "</s>[INST] ok [/INST]"
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], rows.schema)
    chats = chat.format_chats(rows.unionByName(own), byte_bpe()).select("conv_id", "formatted", "starts", "ends", "mask")
    return chats.mapInArrow(read_chats, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


@query()
def op5_benchmark_decontamination(spark, folder):
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SECRETS = r"""
with texts as (select doc_id, source, lang, coalesce(text, '') as text from documents),
found as (
    select 0 as k, doc_id, regexp_extract_all(text, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) as w,
        regexp_extract_all(text, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) as v,
        string_split_regex(text, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as g from texts
    union all select 1, doc_id, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') from texts
    union all select 2, doc_id, regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), string_split_regex(text, '[0-9a-f]+') from texts
    union all select 3, doc_id, regexp_extract_all(text, '[A-Za-z0-9+/_-]+'), regexp_extract_all(text, '[A-Za-z0-9+/_-]+'), string_split_regex(text, '[A-Za-z0-9+/_-]+') from texts),
each as (
    select k, doc_id, generate_subscripts(w, 1) as i, unnest(w) as w, unnest(v) as v, unnest(g[1:len(w)]) as g from found where len(w) > 0),
placed as (
    select k, doc_id, v, sum(length(g) + length(w)) over (partition by k, doc_id order by i) - length(w) as b,
        sum(length(g) + length(w)) over (partition by k, doc_id order by i) as e from each),
kept as (
    select * from placed where length(v) >= case k when 0 then 6 when 1 then 20 else 24 end
        and (k < 3 or (regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[0-9]')))),
holders as (select distinct v, coalesce('+' || source, '-') as owner, coalesce('+' || lang, '-') as repo from kept join texts using (doc_id)),
owned as (select v, count(distinct owner) as owners, count(distinct (owner, repo)) as repos from holders group by v),
judged as (
    select doc_id, k, b, e, owners, repos, owners <= 1 and repos <= 2 as live, ['assign', 'access', 'hex', 'opaque'][k + 1] || ':' || b::bigint || ':' || e::bigint as span
    from kept join owned using (v))
select t.doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access,
    count(*) filter (where k = 2) as n_hex,
    sha256(coalesce(string_agg(span, ',' order by b, k) filter (where k < 3), '')) as base_sha256,
    coalesce(string_agg(span, ',' order by b, k) filter (where k < 3 or live), '') as spans,
    count(*) filter (where live) as n_live, count(*) filter (where not live) as n_example,
    coalesce(max(owners), 0)::bigint as most_owners, coalesce(max(repos), 0)::bigint as most_repos
from texts t left join judged using (doc_id) group by t.doc_id
"""


@query(SECRETS)
def op6_secret_scan(spark, folder):
    found = secrets.scan(table(spark, folder, "documents"), repo_col="lang")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(secrets.KINDS)],
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        "n_live",
        "n_example",
        "most_owners",
        "most_repos",
    )


@query()
def op7_quality_rules(spark, folder):
    docs = table(spark, folder, "documents")
    found = quality_rules.apply_rules(docs, quality_rules.fit(docs, table(spark, folder, "labels")))
    return found.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "score")


@query()
def op8_sharding(spark, folder):
    placed = sharding.shard(table(spark, folder, "documents"), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query()
def op9_suffix_dedup(spark, folder):
    spans = suffix_dedup.repeated_passages(table(spark, folder, "documents"))
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


@query()
def op10_quality_classifier(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    network = quality_classifier.fit(docs, labels.filter(~held_out))
    scored = quality_classifier.classify(docs, network)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


AUDIT = r"""
with docs as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
firsts as (select text, min(doc_id) as first from docs group by text),
marks as (select doc_id, max(coalesce(quality, 0) = 1) as good, max(coalesce(toxic, 0) = 1) as toxic from labels group by doc_id),
flagged as (
    select part, (len(words) < 100)::int + 2 * (100 * list_unique(words) < 80 * len(words))::int
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::int
        + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as failed,
        coalesce(good, false) as good, coalesce(toxic, false) as toxic
    from docs join firsts using (text) left join marks using (doc_id)),
cells as (
    select part, failed, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
    from flagged group by part, failed),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
orders as (
    select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
    from letters a, letters b, letters c, letters d, letters e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (
    select filter_order, k as step, bits[k] as bit, coalesce(list_sum(bits[1:k - 1]), 0)::int as gone
    from orders, unnest([1, 2, 3, 4, 5]) as t(k)),
found as (
    select part, filter_order, step, bit,
        coalesce(sum(n) filter (where failed & (bit | gone) = 0), 0)::bigint as kept,
        coalesce(sum(n) filter (where failed & bit > 0 and failed & gone = 0), 0)::bigint as removed,
        coalesce(sum(n) filter (where failed & bit > 0 and failed & gone > 0), 0)::bigint as redundant,
        coalesce(sum(n) filter (where failed = bit), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (where failed & bit > 0 and failed & gone = 0), 0)::bigint as good_lost,
        coalesce(sum(toxic) filter (where failed & bit > 0 and failed & gone = 0), 0)::bigint as toxic_lost
    from cells, steps group by part, filter_order, step, bit)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) over (partition by part, bit))::bigint as shapley
from found
"""


@query(AUDIT)
def op11_filter_audit(spark, folder):
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op12_window_packing(spark, folder):
    return window_packing.pack_documents(table(spark, folder, "documents"), byte_bpe())


MANIFEST = r"""
with recursive given as (
    select doc_id, source, text, lang, n_chars, list_reduce(
            list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint)),
            lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda k: 0::ubigint)),
                lambda x, k: xor(x >> 1, 3988292384::ubigint * (x & 1)))) & 1 = 1 as even  -- the last step inverts all bits
    from documents),
parts as (
    select *, list_transform([doc_id::varchar, source, lang, n_chars::varchar, text],
            lambda v: coalesce(strlen(v) || ':' || v, '-')) as parts,
        coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') as cut from given),
hashed as (
    select doc_id, source, sha256(list_aggregate(parts, 'string_agg', '')) as leaf,
        sha256(list_aggregate(list_append(parts[1:4], case when even then cut else parts[5] end), 'string_agg', '')) as start from parts),
leaves as (
    select *, coalesce('=' || source, '') as tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
        count(*) over (partition by source) as n from hashed),
low as (
    select tree, 0 as lvl, pos, leaf as h, n from leaves
    union all
    select tree, lvl + 1, pos // 3, sha256(string_agg(h, '' order by pos)), (n + 2) // 3 from low where n > 1 group by tree, lvl, pos // 3, n),
subroots as (select tree, h, lvl as top, row_number() over (order by tree) - 1 as pos, count(*) over () as n from low where n = 1),
high as (
    select 0 as lvl, pos, h, n from subroots
    union all
    select lvl + 1, pos // 3, sha256(string_agg(h, '' order by pos)), (n + 2) // 3 from high where n > 1 group by lvl, pos // 3, n),
steps as (
    select l.tree, l.pos, x.lvl as k, coalesce(string_agg(x.h, '' order by x.pos) filter (where x.pos < l.pos // (3 ** x.lvl)::bigint), '') as before,
        coalesce(string_agg(x.h, '' order by x.pos) filter (where x.pos > l.pos // (3 ** x.lvl)::bigint), '') as after
    from leaves l join low x on x.tree = l.tree and x.n > 1 and x.pos // 3 = l.pos // (3 ** (x.lvl + 1))::bigint group by l.tree, l.pos, x.lvl
    union all
    select l.tree, l.pos, 1000 + x.lvl, coalesce(string_agg(x.h, '' order by x.pos) filter (where x.pos < s.pos // (3 ** x.lvl)::bigint), ''),
        coalesce(string_agg(x.h, '' order by x.pos) filter (where x.pos > s.pos // (3 ** x.lvl)::bigint), '')
    from leaves l join subroots s on s.tree = l.tree join high x on x.n > 1 and x.pos // 3 = s.pos // (3 ** (x.lvl + 1))::bigint
    group by l.tree, l.pos, x.lvl),
proofs as (
    select tree, pos, string_agg(before || after, '' order by k) as proof, list(before || '|' || after order by k) as path
    from steps group by tree, pos)
select doc_id, leaf, s.h as subroot, r.h as root, sha256(coalesce(proof, '')) as proof_sha256,
    list_reduce(list_prepend(start, coalesce(path, [])), lambda now, x: sha256(split_part(x, '|', 1) || now || split_part(x, '|', 2))) as folded_root,
    folded_root = r.h as verified
from leaves l join subroots s on s.tree = l.tree join high r on r.n = 1 left join proofs p on p.tree = l.tree and p.pos = l.pos
"""


@query(MANIFEST)
def op13_merkle_manifest(spark, folder):
    return merkle.manifest(table(spark, folder, "documents"))
