"""The text operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavetable.llm import chat, decontamination, line_dedup, minhash, packing, quality_classifier, quality_rules, secrets, sharding, suffix_dedup
from wavetable.llm.queries import QUERIES, byte_bpe

SF = "/root/testdata/sf0.001"
WORDS = "the and of thing ring able ness tion ed er anon lore mist sand".split()
# columns that clash with names the operators use inside, and one that is all null
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, rank string, component string, bin int, host_key string, nothing string"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(WORDS) for _ in range(words))


def documents() -> list[tuple[int, str | None]]:
    base = prose(1, 120)
    near = base.split()
    near[5], near[60] = "Changed", "words"
    shared = prose(2, 60)
    return [
        (1, base), (2, " ".join(near)), (3, base), (3, base), (4, None), (5, ""), (6, " \n\t "), (7, prose(3, 30_000)), (8, "one"), (9, "one"),
        (10, f"{prose(4, 40)}\n{shared}\n{prose(5, 40)}"), (11, f"{prose(6, 30)}\n{shared} {prose(7, 20)}"), (12, prose(8, 200)),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src" if i % 2 else None, "en", len(t or ""), "r", "c", 1, "h", None) for i, t in documents()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


# --- packing


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(byte_bpe())
    rows = packing.pack_documents(docs, byte_bpe()).collect()
    expected = defaultdict(int)
    for i, text in documents():
        ids = np.array([*tool.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or min(len(ids), 1024)
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            expected[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    assert got == expected
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts))
        assert sum(n for _, n in parts) <= 1024


def test_packing_empty(empty):
    assert packing.pack_documents(empty, byte_bpe()).collect() == []


@pytest.mark.parametrize("text", ["", " ", "a b", " a", "a ", "a  b", "a \n b", "x<|endoftext|>y z", "é è ü　ß", "don't 12 x_y 日本語 😀 ok", "a  b"])
def test_encoder_equals_tokenizers(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(byte_bpe()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(byte_bpe())(text), "<u4").tolist() == whole


def test_packing_close_to_the_bound(spark):
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in rng.integers(1, 1025, 3000)] + [1024] * 200 + [300] * 900
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long")
    rows = packing.pack(pieces, ["id"]).collect()
    assert sorted(r.id for r in rows) == list(range(len(lengths)))
    best_fit = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(best_fit) if room >= n]
        if fits:
            best_fit[min(fits, key=best_fit.__getitem__)] -= n
        else:
            best_fit.append(1024 - n)
    assert len({r.sequence_id for r in rows}) <= 1.01 * len(best_fit)


def test_sequences_hold_the_ids(docs):
    pieces = packing.tokenize(docs.filter("doc_id in (1, 7, 8)").dropDuplicates(["doc_id"]), byte_bpe())
    keys = ["doc_id", "piece"]
    packed = packing.pack(pieces.drop("ids"), keys)
    joined = {r.sequence_id: bytes(r.ids) for r in packing.sequences(pieces, packed, keys).collect()}
    for r in packed.join(pieces.select(*keys, "ids"), keys).collect():
        assert joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


# --- line dedup


def test_lines(spark):
    rows = [(k, "a", f"menu\n text {k}\n\nmenu \nend") for k in range(20)] + [(100 + k, "b", f"menu\nown {k}") for k in range(3)]
    rows += [(200, None, None), (201, None, ""), (202, "a", " \n"), (203, "a", prose(1, 20_000)), (300, "c", "alone\nalone")]
    pages = spark.createDataFrame(rows, "id long, host string, text string")
    pages = pages.withColumn("lines", F.lit("x")).withColumn("salt", F.lit(1))
    out = {r.id: r for r in line_dedup.drop_boilerplate(pages, dropped="gone").collect()}
    assert out[3].text == " text 3\n" and out[3].gone == 3
    assert out[101].text == "own 1" and out[101].gone == 1  # three pages are enough
    assert out[300].text == "alone\nalone"  # a page has no others to share its lines with
    assert out[200].text is None and out[201].text == "" and out[202].text == " \n" and out[203].text == prose(1, 20_000)
    assert line_dedup.drop_boilerplate(pages.limit(0)).collect() == []


def test_lines_of_large_hosts(spark, monkeypatch):
    rows = [(k, f"h{k % 7 if k % 3 else 'ot'}", f"menu {k % 7 if k % 3 else 0}\nline {k % 40}\nown {k}") for k in range(600)]
    pages = spark.createDataFrame(rows, "id long, host string, text string").repartition(4)
    found = lambda: sorted(map(tuple, line_dedup.drop_boilerplate(pages, dropped="gone").collect()))
    whole = found()
    assert {r[3] for r in whole} == {1}
    monkeypatch.setattr(line_dedup, "HOST_PAGES", 9)
    assert found() == whole
    assert line_dedup.large_hosts(spark.createDataFrame([("a", 100), ("b", 9)], "host string, pages long")).collect() == [("a", 12)]


def test_line_dedup_of_the_given_pages_removes_lines(spark):
    rows = QUERIES["op2_line_dedup"](spark, "/root/testdata/sf0.01").agg(F.sum("n_dropped"), F.count_if(F.col("n_dropped") > 0)).first()
    assert rows[0] > 100 and rows[1] > 50


@pytest.mark.parametrize("once", [False, True])
def test_line_dedup_odd_rows(spark, empty, once):
    rows = [(1, None, None), (2, None, "a\nb"), (3, None, "a\nc"), (4, "x", ""), (None, "x", "q"), (None, "x", "q")]
    pages = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(c) for c in ("host", "salt", "lines", "row", "parts")})
    out = line_dedup.drop_boilerplate(pages, "source", copies_once=once).collect()
    expected = [(1, None), (2, "b"), (3, "c"), (4, ""), (None, "q" if once else ""), (None, "q" if once else "")]
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(expected, key=str)
    assert out[0].salt == "salt" and line_dedup.drop_boilerplate(empty, "source", copies_once=once).collect() == []


def test_copied_documents_stay_in_line_dedup(spark):
    """Exact and near copies that hold a third of a source don't make their own lines boilerplate."""
    template, rows = [prose(300 + k, 30) for k in range(6)], []
    for k in range(40):
        rows.append((k, f"license\n{prose(400 + k, 40)}\n{prose(500 + k, 9)}", "s"))
    rows += [(100 + k, "license\n" + prose(600, 30) + "\n" + prose(601, 20), "s") for k in range(20)]
    rows += [(150 + k, prose(602, 25), "s") for k in range(30)]
    for k in range(20):
        lines = [x.split() for x in template]
        lines[k % 6][7] = f"own{k}"
        rows.append((200 + k, "\n".join(map(" ".join, lines)), "s"))
    parts = [prose(700 + k, 12) for k in range(5)]  # far from each other, but without a line of their own
    rows += [(300 + k, "\n".join(p for j, p in enumerate(parts) if k >> j & 1), "t") for k in range(1, 32)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, source string, n_chars long").repartition(3)
    clean = corpus_pipeline.written(corpus_pipeline.without_boilerplate(spark, docs, SF))
    found = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert found == {i: (t := text.removeprefix("license\n"), len(t)) for i, text, _ in rows}
    left = {r.doc_id for r in corpus_pipeline.one_of_each(spark, clean, SF).collect()}
    assert {i for i in left if i < 300} == {*range(40), 100, 150, 200}


# --- near duplicates


def brute_components(rows, width):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(docs):
    out = minhash.near_duplicates(docs, width=2).collect()
    assert len(out) == len(documents())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(documents(), 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_chain(spark):
    """Each text differs a little from the one before; the ends are linked only through the others."""
    chain, rows = prose(11, 100).split(), []
    for k in range(40):
        chain = [*chain]
        chain[(7 * k) % 100] = f"step{k}"
        rows.append((k, " ".join(chain)))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, 2)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_in_large_groups(spark, monkeypatch, width):
    """Variants of two templates around the threshold; all buckets count as large, so pairs come from the groups' cores."""
    monkeypatch.setattr(minhash, "FEW", 1)
    rng, rows = random.Random(3), []
    templates = [prose(21, 120).split(), prose(22, 120).split()]
    for k in range(90):
        words = [*templates[k % 3 == 0]]
        for place in rng.sample(range(120), rng.randint(0, 9 if width == 2 else 4)):
            words[place] = rng.choice(["one", "two", f"own{k}"])
        rows.append((k, " ".join(words)))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, width)


def test_remaining_keeps_every_link(spark, monkeypatch):
    """Without known components, the pairs hold every link of a group."""
    monkeypatch.setattr(minhash, "FEW", 1)
    rng, words, rows = random.Random(4), prose(23, 60).split(), []
    for k in range(40):
        rows.append((k, " ".join(rng.choice(["one", "two", f"own{k}"]) if rng.random() < 0.03 else w for w in words)))
    sets = {k: set(minhash.shingles(text, 2).tolist()) for k, text in rows}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    members = spark.createDataFrame([(0, k, k) for k, _ in rows], "band long, id long, component long")
    pairs = minhash.remaining(members, spark.createDataFrame(rows, "id long, text string"), 2, 80)
    assert linked and linked <= {tuple(p) for p in pairs.collect()}


def test_remaining_searches_every_text_of_an_id(spark, monkeypatch):
    """In a large bucket, an id with two texts is linked to the partners of both."""
    monkeypatch.setattr(minhash, "FEW", 1)
    one, two = prose(41, 60), prose(42, 60)
    rows = [(0, one), (0, two), (1, one.replace(one.split()[30], "changed")), (2, two.replace(two.split()[30], "changed"))]
    members = spark.createDataFrame([(0, k, k) for k in range(3)], "band long, id long, component long")
    pairs = minhash.remaining(members, spark.createDataFrame(rows, "id long, text string"), 2, 80)
    assert {(0, 1), (0, 2)} <= {tuple(p) for p in pairs.collect()}


def test_near_duplicates_of_nothing(empty):
    assert minhash.near_duplicates(empty).collect() == []


def test_keep_first(docs):
    kept = minhash.keep_first(docs, width=2)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 8, 10, 11, 12]


def test_keep_first_with_null_and_reused_ids(spark):
    """Rows are told apart by their texts; a null id or one used again loses no text."""
    one, two, three = prose(31, 60), prose(32, 60), prose(33, 60)
    near = one.replace(one.split()[-1], "changed")
    rows = [(None, one), (None, two), (None, two), (1, three), (1, None), (1, near), (2, three), (2, ""), (None, None), (None, " \n")]
    table = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    kept = minhash.keep_first(table)
    assert kept.columns == table.columns and kept.dtypes == table.dtypes
    got = kept.collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted(
        [(0, two), (1, three), (1, near), (1, ""), (2, ""), (0, ""), (0, " \n")]
    )
    assert {r.row for r in got} >= {3, 4, 5, 7, 8, 9}
    assert minhash.keep_first(table.limit(0)).collect() == []


def test_near_duplicates_with_null_ids(spark):
    """A null id links others and is never chosen before an id."""
    words = prose(41, 100).split()
    steps = [" ".join(["x"] * k + words[k:]) for k in (0, 12, 24)]  # neighbours are near, the ends are not
    lone = prose(42, 60)
    rows = [(5, steps[0]), (None, steps[1]), (3, steps[2]), (None, lone), (None, lone), (7, None), (None, ""), (9, prose(43, 60)), (9, steps[0]), (9, " ")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string").repartition(3)
    sets = [{tuple(w[k : k + 2]) for k in range(len(w) - 1)} for w in (s.split() for s in steps)]
    near = [100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in ((0, 1), (1, 2), (0, 2))]
    assert near == [True, True, False]
    got = [(r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in minhash.near_duplicates(table, width=2).collect()]
    want = [(5, True, 3, False), (None, True, 3, False), (3, True, 3, True), (None, True, None, True), (None, True, None, True)]
    want += [(7, False, 7, True), (None, False, None, True), (9, True, 3, False), (9, True, 3, False), (9, False, 3, False)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_components_of_a_path(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 300), (7, 7)]
    out = minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in out} == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 300: 100}


# --- chat


def test_chat_round_trip(spark):
    rng, bits = random.Random(5), ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "[", "ROLE]", "[END]", "<|endoftext|>", " ", "é", "😀", "ok\n"]
    text = lambda: rng.choice([None, "", "".join(rng.choices(bits, k=rng.randint(1, 8)))])
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "<s>", None]), text(), "x") for c in range(40) for t in range(rng.randint(1, 5))]
    rows += [(99, 0, "assistant", prose(1, 8000), "x"), (98, 0, "user", "a", "x"), (98, 0, "user", "a", "x")]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"), byte_bpe()).collect()
    turns = defaultdict(list)
    for c, t, role, said, _ in rows:
        turns[c].append((t, role is not None, role or "", said or "", role))
    assert len(chats) == len(turns)
    for r in chats:
        expected = [(role, said) for _, _, _, said, role in sorted(turns[r.conv_id], key=lambda x: x[:4])]
        assert chat.read_back(r.formatted) == expected
        assert chat.loss_text(r.formatted, r.starts, r.ends, r["mask"]) == "".join(said for role, said in expected if role == "assistant")


def test_loss_mask_against_every_character():
    rng = random.Random(11)
    for _ in range(300):
        cuts = sorted({0, *rng.choices(range(40), k=rng.randint(0, 12)), 40})
        starts, ends = np.array(cuts[:-1]), np.array(cuts[1:])
        bounds = sorted(rng.choices(range(41), k=2 * rng.randint(0, 4)))
        spans = list(zip(bounds[::2], bounds[1::2]))
        plain = [any(a <= c < b for a, b in spans) for c in range(40)]
        assert chat.loss_mask(starts, ends, spans).tolist() == [any(plain[a:b]) for a, b in zip(starts, ends)]


def test_chat_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), byte_bpe()).collect() == []


# --- decontamination


def sellers(pattern, text):
    column, out = list(range(len(pattern) + 1)), []
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(column[i] + 1, new[-1] + 1, column[i - 1] + (p != c)))
        column = new
        out.append(column[-1])
    return out


def test_myers_distance():
    rng = random.Random(2)
    for _ in range(300):
        pattern, text = ("".join(rng.choices("abc", k=rng.randint(1, 70))) for _ in range(2))
        assert list(decontamination.distances(pattern, text)) == sellers(pattern, text)


def test_leaks(spark):
    item, other = prose(21, 15), prose(22, 12)
    typo = item[:20] + "X" + item[21:60] + item[62:]
    far = " ".join(w if k % 2 else "no" for k, w in enumerate(item.split()))
    rows = [(1, f"before {item.upper()} after"), (2, f"A, {typo}. B"), (3, far), (4, None), (5, ""), (6, prose(23, 20_000) + "\n" + other), (6, f"{item} {item}"), (7, prose(24, 90))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "too short"), (5, "")], "item_id long, text string")
    found = decontamination.leaks(docs, bench).collect()
    expected = set()
    for i, t in rows:
        for k, q in ((1, item), (2, other)):
            q, text = decontamination.normal(q), decontamination.normal(t or "")
            if len(text) < 5000 and min(sellers(q, text), default=99) <= len(q) * 6 // 100 or q in text:
                expected.add((i, k))
    assert {(r.doc_id, r.item_id) for r in found} == expected == {(1, 1), (2, 1), (6, 2), (6, 1)}
    assert sum(r.doc_id == 6 and r.item_id == 1 for r in found) == 2
    one = next(r for r in found if r.doc_id == 1)
    assert rows[0][1][one.start : one.end] == item.upper() and one.distance == 0
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7]
    assert decontamination.leaks(docs, bench.limit(0)).collect() == [] == decontamination.leaks(docs.limit(0), bench).collect()


def test_leaks_of_short_items(spark):
    """Few words have to occur whole and exactly; a long item without spaces is searched with edits."""
    script = "".join(chr(0x4E00 + (7 * k * k) % 5000) for k in range(60))
    rows = [(1, "Say: too, SHORT!"), (2, "too shorter, not too"), (3, f"x {script[:30]}Q{script[31:]} y"), (4, "tooshort"), (5, "into short"), (6, "too short too short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Too short"), (2, script), (3, "..."), (4, "")], "item_id long, text string")
    found = sorted(tuple(r) for r in decontamination.leaks(docs, bench).collect())
    assert found == [(1, 1, 0, 5, 15), (3, 2, 1, 2, 62), (6, 1, 0, 0, 9), (6, 1, 0, 10, 19)]
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()) == [2, 4, 5]


def test_contamination_is_dropped_block_by_block(spark, monkeypatch):
    """No more than one block of items is taken before the documents of the block before are written."""
    items = [prose(800 + k, 12) for k in range(3)]
    docs = spark.createDataFrame([(k, f"a {t} b") for k, t in enumerate([*items, prose(810, 40)])], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    events, blocks, written = [], decontamination.blocks, decontamination.written

    def noted(*args):
        for chunk in blocks(*args):
            events.append("block")
            yield chunk

    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 1)
    monkeypatch.setattr(decontamination, "blocks", noted)
    monkeypatch.setattr(decontamination, "written", lambda df: events.append("written") or written(df))
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()] == [3]
    assert events == ["block", "block", "written", "block", "written"]


# --- secrets


def base_spans(text):
    out = []
    kinds = [
        ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
        ("access", re.compile("(AKIA[A-Z0-9]+)"), 1, 20),
        ("hex", re.compile("([0-9a-f]+)"), 1, 24),
    ]
    for order, (kind, pattern, group, least) in enumerate(kinds):
        out += [(m.start(), order, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out)


def test_secrets(spark):
    live, example = "Ab3" + "xYz9Qw" * 4, "Zx8" + "kLm4Pq" * 4
    texts = [
        "password: token: abcdef1 Secret='a.b=c/9'", "é😀 api_key = 123456 apikey=12345", "x AKIA" + "A1" * 8 + "AKIAAKIA " + "AKIA" * 3, "0" * 23 + " " + "af" * 20,
        f"use {live} here {example}", f"use {example}", "", None, "TOKEN==  abc", "token=" + "a" * 50_000,
    ]
    rows = [(k, t, f"s{k}" if k else None, "en", "x") for k, t in enumerate(texts)]
    rows.append(rows[0])
    out = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, row string")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert [(s.start, s.kind, s.end) for s in r.base] == base_spans(texts[r.doc_id] or "")
        assert [s.value for s in r.added] == ([live] if r.doc_id == 4 else [])
    assert next(r.n_example for r in out if r.doc_id == 5) == 1
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string, source string, lang string")).collect() == []


def test_values_of_many_repositories_of_one_owner_are_examples(spark):
    value = lambda k: f"Ab3{k}" + "xYz9Qw" * 4
    rows = [(k, f"use {value(0)} and {value(1) if k < 2 else ''}", "owner", f"repo{k}") for k in range(5)]
    rows += [(10, f"use {value(2)}", "owner", None), (11, f"use {value(2)}", None, None), (12, f"use {value(3)}", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    found = {r.doc_id: r for r in secrets.scan(docs, repo_col="repo").collect()}
    assert [s.value for s in found[0].added] == [value(1)] and found[0].n_example == 1 and found[0].most_repos == 5
    assert not found[4].added and found[4].n_example == 1 and found[4].most_owners == 1
    assert not found[10].added and found[10].most_owners == 2 and [s.value for s in found[12].added] == [value(3)]
    assert [s.value for r in secrets.scan(docs.filter("doc_id = 4")).collect() for s in r.added] == [value(0)]


def test_secrets_of_a_text_with_many_matches(spark):
    import time

    seconds = []
    for count in (20_000, 40_000):
        text = " ".join(f"{k:030x}" for k in range(count))
        started = time.time()
        out = secrets.scan(spark.createDataFrame([(1, text, "s", "en")], "doc_id long, text string, source string, lang string")).collect()
        seconds.append(time.time() - started)
        assert [(s.start, s.end) for s in out[0].base] == [(31 * k, 31 * k + 30) for k in range(count)]
    assert seconds[1] < 4 * seconds[0] + 2


# --- quality rules


def test_labelled_sample_is_bounded_for_repeated_ids(spark):
    rows = [(1, f"text {k % 300}") for k in range(3000)] + [(2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, quality int")
    found = quality_rules.labelled(docs, labels, "doc_id", "text", "quality", 2)
    assert quality_rules.smallest(found, 2).count() == 2 and quality_rules.smallest(found, 10_000).count() == 3001
    assert quality_rules.fit(docs, labels, sample=5) is not None
    assert quality_classifier.fit(docs, labels, sample=5) is not None


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = defaultdict(list)
    for k in range(len(w) - 4):
        windows[tuple(w[k : k + 5])].append(k)
    repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


@pytest.mark.parametrize("text", ["", " \n", "a b c d e f a b c d e", "x " * 30, "é ü ß 日本\nA\nA\n\nA ", "a#$ | <b>\x0b*\x1cx\x85y", prose(3, 3000) + " q" * 9])
def test_quality_counts(text):
    assert quality_rules.statistics(text)[0] == plain_counts(text)


def test_quality_rules(spark, docs, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("text", F.lit("x"))
    forest = quality_rules.fit(table, labels)
    judged = {r.doc_id: r for r in quality_rules.apply_rules(table, forest).collect()}
    for r in labels.collect():
        assert judged[r.doc_id].base_failed or judged[r.doc_id].kept == bool(r.quality)
    kept = quality_rules.keep_good(docs, forest)
    assert kept.columns == docs.columns and 4 not in [r.doc_id for r in kept.collect()]
    assert quality_rules.keep_good(empty, forest).collect() == []
    untaught = quality_rules.fit(table, labels.limit(0))
    assert all(r.kept != r.base_failed for r in quality_rules.apply_rules(table, untaught).collect())


def test_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((800, len(quality_rules.FEATURES)))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + 0.4 * rng.normal(size=800) < 0.6).astype(float)
    forest = quality_rules.boost(x, y)
    grid = np.repeat(x[:20], 50, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 50), 20)
    assert (np.diff(forest.margin(grid).reshape(20, 50), axis=1) <= 1e-9).all()


# --- sharding


def least_maximum(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, middle
            room -= s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


def test_sharding(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["hot " * 500, prose(k % 300, rng.randint(1, 60)), None, ""]), "x") for k in range(900)] + [(1, "again", "y"), (1, "again", "y")]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, shard string"), 8).collect()
    assert len(out) == len(rows)
    groups, shard_of = defaultdict(int), {}
    for r in out:
        groups[r["key"]] += r["size"]
        assert shard_of.setdefault(r["key"], r.shard) == r.shard
    totals, slots = defaultdict(int), defaultdict(list)
    for r in out:
        totals[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert max(totals.values()) == least_maximum([groups[k] for k in sorted(groups)], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = defaultdict(set)
    for i, t, _ in rows:
        texts[i].add((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    assert all((r["size"], r.text_crc32) in texts[r.doc_id] for r in out)


def test_sharding_few_groups(spark):
    out = sharding.shard(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), 16).collect()
    assert len(out) == 2 and all(0 <= r.shard < 16 for r in out)
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 16).collect() == []


# --- repeated passages


def brute_passages(rows, least):
    texts = {(i, t or ""): words(t) for i, t in rows}
    owners = defaultdict(set)
    for (i, text), w in texts.items():
        for k in range(len(w) - least + 1):
            owners[tuple(w[k : k + least])].add((i, text))
    out = set()
    for (i, _), w in texts.items():
        span = None
        for k in range(len(w) - least + 1):
            if len(owners[tuple(w[k : k + least])]) > 1:
                if span and k <= span[1]:
                    span = (span[0], k + least)
                else:
                    out |= {(i, *span)} if span else set()
                    span = (k, k + least)
        out |= {(i, *span)} if span else set()
    return out


def test_repeated_passages(spark, docs, empty):
    found = {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(docs).collect()}
    assert found == brute_passages(documents(), 50) and len(found) == 6
    assert suffix_dedup.repeated_passages(empty).collect() == []
    passages = suffix_dedup.cut_passages(docs, suffix_dedup.repeated_passages(docs)).collect()
    assert any(r.passage == prose(2, 60) for r in passages)


def test_passages_in_different_company(spark):
    """Partners that match on the left, on the right, or only just long enough."""
    rng = random.Random(9)
    bits, rows = [prose(30 + k, n) for k, n in enumerate((30, 25, 26, 49, 50, 51, 80))], []
    for k in range(60):
        rows.append((k, " ".join(x for _ in range(4) for x in (rng.choice(bits), prose(1000 + 7 * k, rng.randint(0, 3))))))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(table).collect()}
    assert found == brute_passages(rows, 50)


# --- classifier


def test_classifier_held_out(spark):
    rows = QUERIES["op10_quality_classifier"](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_classifier_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (12, 1, None), (7, 0, 0), (99, None, 0)], "doc_id long, quality int, text int")
    network = quality_classifier.fit(docs, labels)
    assert all(0 <= r.score <= 1 for r in quality_classifier.classify(docs, network).collect())
    assert quality_classifier.classify(docs, network).count() == docs.count()
    untaught = quality_classifier.fit(empty, labels.limit(0))
    assert quality_classifier.classify(docs, untaught).count() == docs.count() and quality_classifier.classify(empty, untaught).collect() == []


def test_attention_gradient():
    rng = np.random.default_rng(0)
    bags = [rng.random((n, quality_classifier.WIDTH)) for n in (1, 3, 5)]
    network = quality_classifier.train(bags, np.array([1.0, 0.0, 1.0]))
    x, starts, y = np.concatenate(bags), np.array([0, 1, 4]), np.array([0.0, 1.0, 0.0])
    found = network.gradient(x, starts, y)

    def loss():
        p = network.forward(x, starts)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name in ("encode", "tanh", "gate", "attend", "out"):
        flat, place = network.weights[name], np.unravel_index(3, network.weights[name].shape)
        before = flat[place]
        flat[place] = before + 1e-5
        high = loss()
        flat[place] = before - 1e-5
        low = loss()
        flat[place] = before
        assert abs((high - low) / 2e-5 - found[name][place]) < 1e-5


# --- pipeline


def test_pipeline_stages(spark):
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    texts = {r.doc_id: r.text for r in docs.collect()}
    bench = [decontamination.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, SF))
        rows = out.collect()
        seen.append({r.doc_id for r in rows})
        if name != "best-fit packing":
            assert out.columns == docs.columns
        if name == "minhash near-dedup":
            assert seen[-1] == {i for i, (_, c) in brute_components([(r.doc_id, r.text) for r in docs.collect()], 5).items() if i == c}
        if name == "benchmark decontamination":
            before = {r.doc_id: decontamination.normal(r.text) for r in docs.collect()}
            assert not any(b in before[i] for i in seen[-1] for b in bench)
        docs = out
    assert all(later <= earlier for earlier, later in zip(seen, seen[1:]))
    assert {i for i in texts if quality_rules.base_failed(quality_rules.statistics(texts[i])[0])}.isdisjoint(seen[0])


def test_queries_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
