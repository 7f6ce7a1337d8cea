"""The pipeline's stages, one after another, on a small file and on odd rows."""

import zlib

import corpus_pipeline as cp
from test_near import brute_groups, brute_lines
from test_tokens import check_pieces, plain_ids

SF = "/root/testdata/sf0.001"


def test_stages_on_a_file(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "line dedup", "near-dedup", "mixing", "packing"]
    before, kept = docs, {}
    for name, stage in cp.STAGES:
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        out = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        if name != "packing":
            assert out.columns == docs.columns
        kept[name], before = out.collect(), out
    source = {r.doc_id: r for r in docs.collect()}
    clean = {r.doc_id: r for r in kept["toxicity"]}
    assert 0.8 * len(source) < len(clean) < len(source) and all(source[d] == r for d, r in clean.items())
    deduped = {r.doc_id: r.text for r in kept["line dedup"]}
    assert deduped == {d: t for (d, _), t in brute_lines([(d, r.text) for d, r in clean.items()], least=1).items()}
    assert all(r.n_chars == len(r.text) for r in kept["line dedup"])
    groups = brute_groups(list(deduped.items()))
    single = {r.doc_id: r for r in kept["near-dedup"]}
    assert set(single) == set(groups.values())
    mixed = kept["mixing"]
    assert {r.doc_id for r in mixed} <= set(single) and all(single[r.doc_id].text == r.text for r in mixed)
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(mixed) - 1.5 * words(single.values())) < 0.1 * words(single.values())
    once = {d: [r for r in mixed if r.doc_id == d] for d in {r.doc_id for r in mixed}}
    assert max(len(v) for v in once.values()) <= 2
    one = [d for d, v in once.items() if len(v) == 1]
    ids = dict(zip(one, plain_ids([single[d].text for d in one])))
    check_pieces(kept["packing"], {})
    for d, tokens in ids.items():
        pieces = sorted((r for r in kept["packing"] if r.doc_id == d), key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(tokens)
        for r in pieces:
            assert zlib.crc32(bytes().join(i.to_bytes(4, "little") for i in tokens[r.start : r.start + r.length])) == r.ids_crc32


def test_run(spark):
    assert cp.run(spark, SF).count() > 100


def test_odd_rows_pass_all_stages(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "a text without id of some words", "en", None, 3), (3, "same row here twice ok", "en", "a", 1), (3, "same row here twice ok", "en", "a", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for frame in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            frame = stage(spark, frame, SF)
        assert frame.count() >= 0
