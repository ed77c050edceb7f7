"""Filter audit, window packing and Merkle manifest against plain versions."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import duckdb
import numpy as np
import pytest

from wavetable.llm import filter_audit, merkle, window_packing
from wavetable.llm.queries import SQL, byte_bpe

# columns that clash with names the operators use inside, and one that is all null
SCHEMA = (
    "doc_id long, text string, source string, lang string, n_chars long, block string, docs string, tree string, node int, "
    "position int, id string, word string, start string, nothing string"
)


def prose(seed: int, words: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}." if x % 9 == 0 else f"w{x}" for x in rng.integers(0, 3 * words, words))


def documents() -> list[tuple]:
    long = prose(5, 40_000)
    texts = [
        prose(1, 150), prose(1, 150), "the " * 200, None, "", " \n\t\x0b\x0c\r ", "ABC abc", "one $ two", prose(2, 120) + " ABCDEFGH" * 20, long,
        prose(3, 99), prose(4, 100) + "\nline\n", "a b  c", "x" * 9000, "日本。 語", "it ended.\nAnd  began",
    ]
    rows = [(i, t, ("a", "b", None, "")[i % 4], ("en", None, "")[i % 3], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], rows[4], (1, prose(1, 150), "a", "en", None), (None, texts[0], None, None, None), (None, None, "a", "en", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "k", "d", "t", 1, 2, "i", "w", "s", None) for r in documents()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- filter audit


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_term_matrix_counts_every_word(docs):
    shards, dictionary = filter_audit.term_matrix(docs)
    names = {r.term: r.word for r in dictionary.collect()}
    assert len(names) == dictionary.count()
    got = []
    for shard in shards.collect():
        for i, key in enumerate(shard.ids):
            span = slice(shard.starts[i], shard.starts[i + 1])
            got.append((key, {names[t]: n for t, n in zip(shard.terms[span], shard.counts[span])}))
    order = lambda x: (x[0] is not None, x[0] or 0, sorted(x[1].items()))
    assert sorted(got, key=order) == sorted(((r[0], dict(Counter(words(r[1])))) for r in documents()), key=order)
    assert set(names.values()) == {w for r in documents() for w in words(r[1])}


def plain_failures(rows):
    first = {}
    for key, text, *_ in rows:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    for key, text, _, lang, _ in rows:
        text, w = text or "", words(text)
        bad = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": key is not None and first[text] < key,
        }
        yield key, lang or "", {f for f in bad if bad[f]}


def plain_audit(rows, labels):
    good, toxic = ({i for i, *marks in labels if marks[k] == 1} for k in (0, 1))
    out, shapley = {}, Counter()
    docs = list(plain_failures(rows))
    for part in {p for _, p, _ in docs}:
        mine = [(k, bad) for k, p, bad in docs if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                before = set(order[: step - 1])
                left = [d for d in left if f not in d[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in bad and bool(bad & before) for _, bad in mine), sum(bad == {f} for _, bad in mine),
                    sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABELS = [(0, 1, 0), (0, 0, 1), (1, 1, None), (2, None, 1), (6, 0, 0), (99, 1, 1)]


def test_audit_equals_brute_force(spark, docs):
    labels = spark.createDataFrame([(*x, "more") for x in LABELS], "doc_id long, quality int, toxic int, failed string")
    rows = filter_audit.audit(docs, labels).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in rows} == plain_audit(documents(), LABELS)
    assert len(rows) == 600 * 2


def test_audit_without_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, none).collect() == []
    assert {r.good_lost + r.toxic_lost for r in filter_audit.audit(docs, none).collect()} == {0}


def test_blocks_are_cut_by_bytes_and_rows(spark, docs, monkeypatch):
    whole = sorted(map(tuple, filter_audit.failures(docs).collect()), key=str)
    assert filter_audit.cuts(np.array([5, 5, 50, 1, 1, 1]), 10, 2) == [0, 2, 3, 5, 6]
    monkeypatch.setattr(filter_audit, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, filter_audit.failures(docs).collect()), key=str) == whole


# --- window packing


def least_cost(places, penalties, capacity):
    cost = [0] + [10**9] * (len(places) - 1)
    for j in range(1, len(places)):
        spans = [(places[j] - places[i], cost[i]) for i in range(j) if places[j] - places[i] <= capacity]
        cost[j] = min(c + window_packing.padding(int(n), capacity) for n, c in spans) + penalties[j]
    return cost[-1]


@pytest.mark.parametrize("seed", range(40))
def test_windows_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([8, 16, 20, 32]))
    ends = np.unique(rng.integers(1, 120, 8))
    places, penalties = window_packing.cut_places(ends, np.unique(rng.integers(1, ends[-1] + 1, 12)), capacity)
    cuts = window_packing.windows(places, penalties, capacity)
    sizes = np.diff(places[cuts])
    assert sizes.max() <= capacity and places[cuts[-1]] == ends[-1]
    cost = sum(window_packing.padding(int(n), capacity) for n in sizes) + penalties[cuts[1:]].sum()
    assert cost == least_cost(places, penalties, capacity)


def test_window_packing_round_trip(docs, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(window_packing, "BLOCK", 5000)
    tool = Tokenizer.from_file(byte_bpe())
    rows = window_packing.pack_documents(docs, byte_bpe()).collect()
    expected = Counter()
    for key, text, *_ in documents():
        ids = np.array([*tool.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected[key, len(ids)] += 1
    whole = {(r.doc_id, r.doc_tokens) for r in rows}
    assert whole == set(expected)
    for key, n in expected:
        pieces = Counter((r.start, r.length) for r in rows if (r.doc_id, r.doc_tokens) == (key, n))
        assert sum(length * times for (_, length), times in pieces.items()) == n * expected[key, n]
    texts = {r[0]: r[1] for r in documents()[:16]}
    for r in rows:
        if r.doc_id is not None:
            ids = np.array([*tool.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length, r.doc_id, r.start))
    for parts in filled.values():
        parts.sort(key=lambda x: x[0])
        assert [o for o, *_ in parts] == [0, *np.cumsum([n for _, n, *_ in parts])[:-1]]
        assert sum(n for _, n, *_ in parts) <= 2048
        assert all(start == 0 for *_, start in parts[1:])  # only the first piece continues a document


def test_windows_end_with_sentences():
    text = "One two three. Four five!\nSix seven eight"
    ids = np.frombuffer(window_packing.encoder(byte_bpe())(text), "<u4")
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(byte_bpe())
    ends = [0, *window_packing.sentence_ends(ids, byte_bpe()), len(ids)]
    parts = [tool.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])]
    assert [p for p in parts if p.strip()] == ["One two three.", " Four five!", "Six seven eight"]


def test_window_packing_little_padding(spark):
    texts = [(i, prose(i, 30 + 7 * (i % 50))) for i in range(300)]
    rows = window_packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), byte_bpe()).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.sequence_id] += r.length
    assert sum(window_packing.padding(n, 2048) for n in sizes.values()) <= 0.02 * sum(sizes.values())


def test_window_packing_empty(empty):
    assert window_packing.pack_documents(empty, byte_bpe()).collect() == []


# --- Merkle manifest


def h(text):
    return sha256(text.encode()).hexdigest()


def written_out(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def around(levels, i):
    for level in levels[:-1]:
        low = i // 3 * 3
        yield "".join(level[low:i]), "".join(level[i + 1 : low + 3])
        i //= 3


def plain_manifest(rows):
    trees = defaultdict(list)
    for key, text, source, lang, n in rows:
        start = text
        if text is not None and key is not None and zlib.crc32(str(key).encode()) % 2 == 0:
            start = text.replace("\n", "")
        trees[source].append((key, h(written_out(key, source, lang, n, text)), h(written_out(key, source, lang, n, start))))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    low = {s: climb([leaf for _, leaf, _ in trees[s]]) for s in order}
    high = climb([low[s][-1][0] for s in order]) if order else []
    for k, s in enumerate(order):
        for i, (key, leaf, now) in enumerate(trees[s]):
            path = [*around(low[s], i), *around(high, k)]
            for a, b in path:
                now = h(a + now + b)
            yield key, leaf, low[s][-1][0], high[-1][0], h("".join(a + b for a, b in path)), now, now == high[-1][0]


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def many():
    rows = [(i, f"text {i}\n{i % 7}" if i % 5 else None, f"s{i % 13}" if i % 3 else "hot", "en", i) for i in range(260)]
    return [*documents(), *rows, *[(5, "same\n", "hot", None, 1)] * 40]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    rows = spark.createDataFrame(many(), "doc_id long, text string, source string, lang string, n_chars long").repartition(5)
    got = merkle.manifest(rows).collect()
    assert by_id(got) == by_id(plain_manifest(many()))
    assert 0 < sum(not r.verified for r in got) < len(got)


@pytest.mark.parametrize("count", [1, 3, 4, 9, 10, 27, 28])
def test_levels_of_full_and_open_superblocks(count, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    nodes = [str(i) for i in range(count)]
    above = [merkle.levels_of(nodes[i : i + 9], i // 9)[-1][0] for i in range(0, count, 9)]
    while len(above) > 1:
        above = [merkle.levels_of(above[i : i + 9], i // 9)[-1][0] for i in range(0, len(above), 9)]
    assert above == climb(nodes)[-1]


def test_manifest_with_clashing_columns_and_without_rows(docs, empty):
    assert by_id(merkle.manifest(docs).collect()) == by_id(plain_manifest(documents()))
    assert merkle.manifest(empty).collect() == []


def test_manifest_of_one_row(spark):
    rows = [(3, None, None, None, None)]
    got = merkle.manifest(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")).collect()
    leaf = h("1:3----")
    assert by_id(got) == [(3, leaf, leaf, leaf, h(""), leaf, True)]


@pytest.mark.parametrize("name,plain", [("op13_merkle_manifest", lambda rows: by_id(plain_manifest(rows)))])
def test_sql_twin_on_odd_rows(name, plain):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar, lang varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", many())
    assert by_id(con.execute(SQL[name]).fetchall()) == plain(many())
