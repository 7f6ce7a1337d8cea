"""Snapshot collapse against brute force."""

from tidepanel.llm import snapshots


def brute(rows):
    """Rendered conversations that are no prefix of a longer one and no later copy."""
    turns = {}
    none_first = lambda v: (v is not None, v if v is not None else 0)
    text_first = lambda v: (v is not None, v or "")
    for conv, turn, role, text in sorted(rows, key=lambda r: (none_first(r[1]), text_first(r[2]), text_first(r[3]))):
        turns.setdefault(conv, []).append((role, text))
    kept = {}
    for conv in sorted(turns, key=none_first, reverse=False):
        own = turns[conv]
        longer = any(len(o) > len(own) and o[: len(own)] == own for o in turns.values())
        same = [c for c, o in turns.items() if o == own]
        first = min((c for c in same if c is not None), default=None)
        if not longer and conv == first:
            kept[conv] = "".join(f"<|{r or 'unknown' if r is not None else 'unknown'}|>\n{(t or '').replace('<|', '< |')}<|end|>\n" for r, t in own)
    return kept


ROWS = [
    (1, 0, "user", "hi"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "more <|end|>"),
    (4, 0, "user", "hi"), (4, 1, "assistant", "hello"), (4, 2, "user", "more <|end|>"),
    (5, 0, "user", None), (6, 0, "user", ""), (7, 0, None, "x"),
    (8, 0, "user", "twice"), (8, 0, "user", "twice"),
    (9, 0, "user", "twice"),
    (10, None, "system", "first"), (10, 0, "user", "second"),
    (None, 0, "user", "lost"), (None, 1, "user", "id"),
    (11, 5, "user", "hi"),
]


def rendered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.part):
        out[r.conv_id] = out.get(r.conv_id, "") + r.text
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, n string")


def test_odd_rows(spark):
    assert rendered(snapshots.collapse_and_render(frame(spark, ROWS))) == brute(ROWS)


def test_blocks_and_parts_do_not_matter(spark, monkeypatch):
    rows = [(c, t, "user", f"turn {t}") for c, n in ((1, 40), (2, 25), (3, 41)) for t in range(n)] + [(4, t, "user", f"turn {t}" if t != 30 else "other") for t in range(41)]
    monkeypatch.setattr(snapshots, "BLOCK", 7)
    found = snapshots.collapse_and_render(frame(spark, rows), turns_per_part=5)
    assert rendered(found) == brute(rows)
    assert {(r.conv_id, r.part) for r in found.collect()} == {(c, p) for c in (3, 4) for p in range(9)}


def test_empty(spark):
    assert snapshots.collapse_and_render(frame(spark, ROWS).limit(0)).count() == 0
