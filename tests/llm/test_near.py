"""Near duplicates and line dedup against brute force, on files and on planted groups."""

import hashlib
import random
import time
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tidepanel.llm import graph, lines, minhash, queries
from tidepanel.llm.common import Words, staged, words_of

SF = "/root/testdata/sf0.001"


def shingle_set(text, k=5):
    w = words_of(text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_groups(rows):
    """doc_id -> smallest doc_id reachable over links of similarity 0.75."""
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingle_set(t)) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = sorted((root(a), root(b)))
                parent[v] = u
    return {d: root(d) for d in parent}


def variants(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = rng.choice("abcdefghij") * rng.randint(2, 9)
        out.append(" ".join(w))
    return out


def planted(seed=5):
    rng = random.Random(seed)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 7))) for _ in range(n))
    texts = [text(rng.randint(1, 60)) for _ in range(60)]
    for n, length, changes in ((40, 120, 3), (30, 80, 4), (6, 40, 2)):
        texts += variants(rng, text(length), n, changes)
    texts += [texts[0]] * 5 + [texts[70].upper()] * 3 + ["", None, " \n", "one two", "one two", "one two three"]
    chain = text(100).split()
    texts += [" ".join(chain[i * 6 : i * 6 + 70]) for i in range(6)]  # neighbours are similar, ends are not
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


def as_docs(spark, rows):
    return spark.createDataFrame([(d, t, True) for d, t in rows], "doc_id long, text string, kept boolean")


@pytest.mark.parametrize("seed", [5, 6, 7, 8])
def test_planted_groups(spark, seed):
    rows = planted(seed)
    found = minhash.near_duplicates(spark, as_docs(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_groups(rows)
    assert {r.doc_id: r.n_shingles for r in found} == {d: len(shingle_set(t)) for d, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_files(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = minhash.near_duplicates(spark, docs).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_groups([(r.doc_id, r.text) for r in docs.collect()])


def test_repeated_ids_and_missing_ids(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, a), (2, b), (3, a), (3, b), (4, a), (4, a), (None, a), (None, None)]
    found = minhash.near_duplicates(spark, as_docs(spark, rows)).collect()
    assert len(found) == len(rows)
    assert {r.component_id for r in found if r.doc_id is not None} == {1}
    assert all(r.kept and r.component_id is None for r in found if r.doc_id is None)
    stay = minhash.one_of_each_group(spark, as_docs(spark, rows)).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in stay) == [(0, ""), (0, a), (1, a)]
    assert minhash.near_duplicates(spark, as_docs(spark, rows).limit(0)).count() == 0


def test_without_broadcast(spark):
    rows = planted()[:60]
    found = minhash.near_duplicates(spark, as_docs(spark, rows), minhash.NearOptions(broadcast_rows=0)).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_groups(rows)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 240)] + [(5, 5), (3, 4), (4, 3)]
    found = {r.node: r.label for r in graph.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(200, 240)}, 3: 3, 4: 3}


def test_sketch_bound_is_loose_enough():
    rng = random.Random(2)
    for seed in range(40):
        base = " ".join(str(rng.random()) for _ in range(200))
        x, y = (minhash.shingles(t, 5) for t in variants(random.Random(seed), base, 2, 8))
        common = len(x) + len(y) - len({*x.tolist(), *y.tolist()})
        if common >= 0.75 * (len(x) + len(y) - common):
            a, b = (minhash.odd_sketch(minhash.samples(s)) for s in (x, y))
            assert sum(bin((int(p) ^ int(q)) & (1 << 64) - 1).count("1") for p, q in zip(a, b)) <= minhash.MOST_BITS


def test_tiles_keep_every_similar_pair():
    """Every pair that shares a band and reaches 0.75 is linked by links_of_tile itself, whatever the sign of its sketch words."""
    rng, o, tried = np.random.default_rng(3), minhash.NearOptions(), 0
    for i in range(1000):
        words = [f"w{k}" for k in rng.integers(0, 10**9, 300)]
        other = list(words)
        for at in rng.choice(300, rng.integers(1, 9), replace=False):
            other[at] = f"v{i}"
        texts = [" ".join(words), " ".join(other)]
        x, y = minhash.shingle_sets(texts, o.words)
        common = len(np.intersect1d(x, y))
        low = [minhash.samples(s) for s in (x, y)]
        bands = [minhash.band_keys(v) for v in low]
        shared = bands[0][bands[0] == bands[1]]
        if 100 * common < 75 * (len(x) + len(y) - common) or not len(shared):
            continue
        tried += 1
        rows = [(int(shared[0]), "z", 0, 0, k, k, False, 0, bands[k].tolist(), minhash.odd_sketch(low[k]).tolist(), texts[k]) for k in (0, 1)]
        assert minhash.links_of_tile(rows, o) == [(0, 1)]
    assert tried > 700


# ---- lines ------------------------------------------------------------------------------------------------------------


def brute_lines(rows, percent=80, least=4):
    """Texts without the lines that resemble an earlier one, by (doc_id, text)."""
    order = sorted({(d if d is not None else lines.LAST, t or "") for d, t in rows})
    seen, out = [], {}
    # rows that share an id are ordered by a hash of the text, so such rows don't share lines here
    for d, t in order:
        keep = []
        for line in t.split("\n"):
            w = set(line.encode().lower().split())
            similar = len(w) >= least and any(100 * len(w & s) >= percent * len(w | s) for s in seen)
            if len(w) >= least:
                seen.append(w)
            if not similar:
                keep.append(line)
        out[d, t] = "\n".join(keep)
    return {(d, t): None if t is None else out[d if d is not None else lines.LAST, t] for d, t in rows}


def line_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.choice([1, 2, 2, 3, 4, 8])))
    line = lambda n: " ".join(word() for _ in range(n))
    templates = [line(rng.randint(5, 30)) for _ in range(4)]
    rows = []
    for d in range(120):
        own = [line(rng.randint(0, 25)) for _ in range(rng.randint(0, 5))]
        own += variants(rng, rng.choice(templates), rng.randint(0, 4), 3)
        rng.shuffle(own)
        rows.append((d, "\n".join(own)))
    return [*rows, (500, None), (501, ""), (502, "\n\n"), (None, templates[0]), (503, "\n".join([templates[1]] * 3)), (0, rows[0][1])]


@pytest.mark.parametrize(("seed", "first"), [(1, 4), (2, 1)])
def test_lines_against_brute_force(spark, seed, first):
    rows = line_rows(seed)
    docs = as_docs(spark, rows)
    found = lines.dedup_lines(spark, docs, lines.LineOptions(first=first, postings=50)).collect()
    assert len(found) == len(rows)
    expected = brute_lines(rows)
    inverse = {}
    for r in found:
        inverse.setdefault(r.doc_id, set()).add(r.text)
    assert inverse == {d: {v for (e, _), v in expected.items() if e == d} for d, _ in rows}
    assert sum(r.n_removed for r in found) == sum((0 if t is None else t.count("\n") + 1) - (0 if v is None else v.count("\n") + 1 if v or t == v else 0) for (d, t), v in [((d, t), expected[d, t]) for d, t in rows])


def test_short_lines_against_brute_force(spark, tmp_path):
    rows = line_rows(4)[:100]
    rows += [(600 + i, "\n".join(["same three words", "Words  same three", f"n{i}", "one", "", "same", "three same"][: 1 + i % 7])) for i in range(40)]
    expected = {d: v for (d, _), v in brute_lines(rows, least=1).items()}
    as_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op9_line_join(spark, str(tmp_path)).collect()}
    assert {d: r.text_sha256 for d, r in found.items()} == {d: None if v is None else hashlib.sha256(v.encode()).hexdigest() for d, v in expected.items()}
    assert found[606].n_removed > 0


def test_no_lines(spark):
    assert lines.dedup_lines(spark, as_docs(spark, [(1, "x")]).limit(0)).count() == 0
    only_short = lines.dedup_lines(spark, as_docs(spark, [(1, "a b"), (2, "a b")])).collect()
    assert {r.text for r in only_short} == {"a b"}


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_filters_let_nothing_get_lost(spark, bits):
    """A bitmap that is full lets every class through, a wide one hardly any other: the rows are the same."""
    rows = line_rows(3)[:60]
    found = lines.dedup_lines(spark, as_docs(spark, rows), lines.LineOptions(first=1, filter_bits=bits)).collect()
    assert {r.doc_id: r.text for r in found} == {d: v for (d, _), v in brute_lines(rows).items()}


def test_id_filter(spark):
    ids = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    keep = lines.id_filter(spark, spark.createDataFrame([(int(i),) for i in ids], "id long"), 1 << 17)
    assert keep(ids.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 2**63 - 1, 20_000).astype(np.uint64)
    assert keep(others).mean() < 0.02


def test_lines_with_clashing_columns_and_many_lines(spark):
    rows = [(1, "a b c d e f\n" * 3000 + "own words of the first row", 5, "x"), (2, "a b c d e f\nown words of the second row\n\nx", 6, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc long, gone string")
    found = {r.doc_id: r for r in lines.dedup_lines(spark, docs, lines.LineOptions(least_words=1)).collect()}
    assert found[1].text == "a b c d e f\nown words of the first row" or found[1].text == "a b c d e f\n\nown words of the first row"
    assert found[1].n_removed == 2999 and found[2].text == "own words of the second row\n\nx" and (found[2].doc, found[2].gone) == (6, "y")


def test_words_are_hashed_like_one_by_one():
    rng = random.Random(0)
    seen = {}
    for _ in range(200):
        texts = ["".join(rng.choice("aBc \n\t\x0b\x85é") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 6))]
        found = Words(texts)
        expected = [words_of(t) for t in texts]
        assert found.counts.tolist() == [len(w) for w in expected]
        for h, w in zip(found.hashes.tolist(), [w for own in expected for w in own]):
            assert seen.setdefault(w, h) == h
        line, at = [], 0
        for t in texts:
            for own in t.encode().split(b"\n"):
                line += [at] * len(own.split())
                at += 1
        assert found.line.tolist() == line
    assert len(set(seen.values())) == len(seen)
    assert Words(["x y\n" * 200_000, "a b c"]).counts.tolist() == [400_000, 3]


def test_second_pass_sends_the_postings_that_are_asked_for():
    """Of the words that pass the filter every line's posting comes, of others none, and no first or lost lines again."""
    rows = [(d, t) for d, t in line_rows(5) if t]
    texts, o = [t for _, t in rows], lines.LineOptions(least_words=1)
    batch = pa.RecordBatch.from_pydict({"doc": pa.array([d if d is not None else lines.LAST for d, _ in rows], pa.int64()), "tag": pa.array([0] * len(rows), pa.int64()), "text": texts})
    counts = SimpleNamespace(value=np.ones(lines.COUNTERS, np.int64))
    wanted = {int(h) for h in Words([texts[0]]).hashes[:5]}

    def postings(words):
        out = {"posting": [], "first": [], "lost": []}
        for b in lines._emit(counts, o, 64, words)(iter([batch])):
            for kind, raw in zip(b.column("kind").to_pylist(), b.column("data").to_pylist()):
                out[kind].append(raw)
        return out, np.frombuffer(b"".join(out["posting"]), lines.POSTING)

    everything, all_of_them = postings(None)
    some, few = postings(SimpleNamespace(value=lambda h: np.isin(h, np.array(list(wanted), np.uint64))))
    keys = np.array([int(k) for h, k in zip(*_hashes_and_words(texts, counts, o)) if int(h) in wanted], np.uint32)
    assert everything["first"] and everything["lost"] and not some["first"] and not some["lost"]
    assert 0 < len(few) < len(all_of_them)
    assert sorted(few.tolist()) == sorted(all_of_them[np.isin(all_of_them["word"], keys)].tolist())


def _hashes_and_words(texts, counts, o):
    found = list(lines.line_sets(texts, lines.rarity_steps(counts.value), o.least_words))
    return np.concatenate([s.hash for s in found]), np.concatenate([lines.mix64(s.key) >> np.uint64(32) for s in found])


def test_full_sets_look_only_into_lines_that_are_asked_for(monkeypatch):
    texts = ["a b c\nd e f g\n\nh i", "x\ny z"]
    batch = pa.RecordBatch.from_pydict({"doc": pa.array([7, 8], pa.int64()), "tag": pa.array([1, 2], pa.int64()), "text": texts})
    place = lines.place_ids(np.array([7, 8]), np.array([1, 2]), np.array([3, 1]))
    read, whole = [], lines.line_sets
    monkeypatch.setattr(lines, "line_sets", lambda t, *a: read.extend(t) or whole(t, *a))
    wanted = SimpleNamespace(value=lambda ids: np.isin(ids, place))
    out = [r for b in lines._full_sets(SimpleNamespace(value=np.ones(lines.COUNTERS, np.int64)), 1, wanted)(iter([batch])) for r in b.to_pylist()]
    assert read == ["h i", "y z"]
    assert [(r["doc"], r["tag"], r["line"], len(r["words"])) for r in out] == [(7, 1, 3, 16), (8, 2, 1, 16)]


def test_wide_bitmaps_bound_the_words_that_differ():
    """Sets of every width: the bitmaps never differ in more places than the sets do, and tell strangers of 150 words apart."""
    rng, o = random.Random(7), lines.LineOptions(least_words=1)
    base = [f"w{rng.random()}" for _ in range(400)]
    texts = [" ".join(base[:n] + [f"v{rng.random()}" for _ in range(extra)]) for n in (3, 50, 63, 64, 66, 130, 159, 160, 162, 300) for extra in (0, 1, 9)]
    strangers = [" ".join(f"u{rng.random()}" for _ in range(150)) for _ in range(20)]
    (s,) = lines.line_sets(["\n".join(texts + strangers)], lines.rarity_steps(np.ones(lines.COUNTERS, np.int64)), 1)
    p = np.zeros(len(s.id), lines.POSTING)
    p["size"], p["id"], p["bits"], p["odd"], p["one"], p["two"] = s.size, s.id, s.bits, s.odd, s.one, s.two
    words = [set(t.split()) for t in texts + strangers]
    assert [len(w) for w in words] == s.size.tolist()
    x, y = (v.ravel() for v in np.indices((len(p), len(p))))
    apart = lines.bits_apart(p, x, y).reshape(len(p), len(p))
    differ = np.array([[len(a ^ b) for b in words] for a in words])
    assert (apart <= differ).all() and (apart % 2 == differ % 2).all()
    few = differ <= 1
    assert (apart[few] == differ[few]).all()
    most = 300 - 2 * lines.overlap_needed(150, 150, o.percent)
    unlike = apart[len(texts) :, len(texts) :][~np.eye(len(strangers), dtype=bool)]
    assert (unlike > most).all()


def test_strangers_are_no_candidates():
    """Long lines that share a rare word and no more than chance would have it."""
    rng, o = random.Random(8), lines.LineOptions(least_words=1)
    texts = [" ".join(["shared", *(f"u{rng.random()}" for _ in range(149))]) for _ in range(60)]
    near = texts[0].replace("shared ", "shared one ")
    (s,) = lines.line_sets(["\n".join([*texts, near])], lines.rarity_steps(np.ones(lines.COUNTERS, np.int64)), 1)
    p = np.zeros(len(s.id), lines.POSTING)
    p["word"], p["doc"], p["size"], p["id"] = 5, np.arange(len(s.id)), s.size, s.id
    p["bits"], p["odd"], p["one"], p["two"] = s.bits, s.odd, s.one, s.two
    later, earlier, _, _ = lines.candidate_pairs(p, o, None)
    assert [(int(a), int(b)) for a, b in zip(later, earlier)] == [(int(s.id[-1]), int(s.id[0]))]


def test_postings_are_packed_without_loss():
    rng = np.random.default_rng(4)
    for n in (1, 2, 500):
        p = np.zeros(n, lines.POSTING)
        for name in ("word", "id", "doc", "bits", "odd", "one", "two"):
            p[name] = rng.integers(0, 2**63 if p[name].itemsize == 8 else 2**32, n)
        p["doc"][: n // 2] = lines.LAST
        p["doc"][-1] = -5
        p["size"], p["pos"] = rng.choice([1, 64, 65, 160, 161, 70_000], n), rng.integers(0, 65536, n)
        p["odd"][p["size"] <= lines.WIDE] = 0
        p["one"][p["size"] <= lines.WIDEST] = p["two"][p["size"] <= lines.WIDEST] = 0
        assert sorted(lines.unpack_postings([lines.pack_postings(p), lines.pack_postings(p[:1])]).tolist()) == sorted([*p.tolist(), p[0].item()])


def test_staged_tables_that_nothing_reads_are_dropped(spark, tmp_path, monkeypatch):
    from tidepanel import session

    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    found = lines.dedup_lines(spark, as_docs(spark, line_rows(6)[:60]), lines.LineOptions(first=1, least_words=1))
    left = {p.name.split("-")[0] for p in tmp_path.iterdir() if any(p.glob("*.parquet"))}
    assert found.count() == 60 and left <= {"lines", "later"}


def test_staging_leaves_no_exchange_files(spark):
    """The files of an exchange go with the write it was made for."""
    folders = [Path(d.toString()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f.name for d in folders for f in d.rglob("shuffle_*")}
    before = shuffled()
    table = staged(spark, spark.range(1000).selectExpr("id % 100 AS k").groupBy("k").count(), "counts")
    for _ in range(100):  # they are deleted by a thread of its own
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 100
