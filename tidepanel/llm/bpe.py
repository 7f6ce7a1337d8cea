"""Byte-level BPE by the tokenizers library, with a bounded memo of space-separated pieces.

A byte-level BPE never merges across a boundary between a visible character and a single space or line break that precedes
another visible character. Texts are cut there; each distinct piece goes through the library once per worker and its ids are
then looked up. A word and the punctuation mark after it are put together from both. Texts with other white space next to a
space (the pre-tokenizer looks ahead there), or that hold the string of a special token, go through the library whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END, WHOLE = " end", " whole"  # hold a space, so no piece can be equal to them
OPENS = "\uf8ff"  # a piece that opens a text or a line, where no space precedes; texts that hold it are cut at spaces only
MARKS = ".,;:!?"
TOGETHER = 200  # pieces that the library reads as one text
PLAIN = "\u0250"  # letters below are letters in every version of Unicode


def default_vocabulary() -> str:
    """Path of the vocabulary file on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Pieces(dict):
    """piece -> index; unseen pieces get the next index and wait in `fresh`."""

    def __missing__(self, piece):
        index = self[piece] = len(self)
        self.fresh.append(piece)
        return index


class Encoder:
    """encode(texts) gives the ids of all texts, each followed by `end_id`, and the number of ids of each text.

    When more than `max_pieces` distinct pieces are remembered, those that came once are forgotten (and the rarer ones, until a
    half is left).
    """

    def __init__(self, path: str | None = None, end_id: int = 0, max_pieces: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_vocabulary())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end_id, self.max_pieces = end_id, max_pieces
        size = self.tokenizer.get_vocab_size()
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        own = [e.ids for e in self.tokenizer.encode_batch_fast(["\n", *MARKS], add_special_tokens=False)]
        self.cuts_lines = all(len(i) == 1 for i in own)
        self.line, self.marks = own[0][0], dict(zip(MARKS, [i[0] for i in own[1:]])) if self.cuts_lines else {}
        self.reset()

    def reset(self) -> None:
        self.pieces = _Pieces({END: 0, WHOLE: 1, OPENS: 2})
        self.pieces.fresh = []
        self.flat = np.array([self.end_id, self.line], np.uint32)
        self.used, self.start, self.length = 1, np.zeros(3, np.int64), np.array([1, -1, 0], np.int64)
        if self.cuts_lines:
            self.pieces["\n"] = 3
            self.used, self.start, self.length = 2, np.append(self.start, 1), np.append(self.length, 1)
        self.fixed, self.uses = len(self.length), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the pieces that came more than once, at most half of what may be remembered."""
        uses = np.zeros(len(self.length), np.int64)
        uses[: len(self.uses)] = self.uses
        uses[self.length < 0] = 0
        most = self.max_pieces // 2
        least = max(2, int(np.partition(uses, -most)[-most]) + 1) if most and len(uses) > most else 2
        keep = uses >= least
        keep[: self.fixed] = True
        kept = np.flatnonzero(keep)
        old = list(self.pieces)
        size = np.maximum(self.length[kept], 0)
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[kept] - (ends - size), size) + np.arange(int(size.sum()))]
        self.pieces = _Pieces({old[k]: i for i, k in enumerate(kept.tolist())})
        self.pieces.fresh = []
        self.flat, self.used, self.start, self.length, self.uses = ids, len(ids), ends - size, self.length[kept], self.uses[:0]

    def _append(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add entries at the end of the memo; negative lengths mark pieces that must not be looked up."""
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat)), np.uint32)])
        self.flat[self.used : need] = ids
        real = np.maximum(lengths, 0)
        self.start = np.concatenate([self.start, self.used + np.cumsum(real) - real])
        self.length = np.concatenate([self.length, lengths])
        self.used = need

    def _learn(self) -> None:
        fresh, self.pieces.fresh = self.pieces.fresh, []
        if not fresh:
            return
        first, inner, ended = [], [], []
        pieces, marks = self.pieces, self.marks
        for i, piece in enumerate(fresh):
            if piece.isalpha():
                inner.append(i)
            elif piece[-1:] in marks and piece[:-1].isalpha() and max(piece) < PLAIN:
                ended.append((i, pieces[piece[:-1]], marks[piece[-1]]))
            elif piece[:1] == OPENS:
                if len(piece) > 1 and piece[1:].strip() == piece[1:]:
                    first.append(i)
            elif piece and piece.strip() == piece:
                inner.append(i)
        inner += range(len(fresh), len(fresh) + len(pieces.fresh))  # words whose mark was taken off
        fresh += pieces.fresh
        pieces.fresh = []
        lengths = np.full(len(fresh), -1, np.int64)
        alone = self.tokenizer.encode_batch_fast([fresh[i][1:] for i in first], add_special_tokens=False) if first else []
        alone = [e.ids for e in alone]
        lengths[first] = [len(i) for i in alone]
        groups = [inner[k : k + TOGETHER] for k in range(0, len(inner), TOGETHER)]
        joined = ["".join([" " + fresh[i] for i in g]) for g in groups]
        chunks = []
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False) if groups else []):
            ids = np.array(e.ids, np.uint32)
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(g):
                raise ValueError("the vocabulary is not a byte-level BPE that opens words with a space")
            lengths[g] = np.diff(at, append=len(ids))
            chunks.append(ids)
        real, opening = np.maximum(lengths, 0), np.zeros(len(fresh), bool)
        opening[first] = True
        opening = np.repeat(opening, real)
        flat = np.empty(len(opening), np.uint32)
        flat[opening] = [i for own in alone for i in own]
        flat[~opening] = np.concatenate(chunks) if chunks else []
        at = len(self.length)
        self._append(flat, lengths)
        if ended:
            place, word, mark = (np.array(c, np.int64) for c in zip(*ended))
            size = self.length[word]
            ends = np.cumsum(size + 1)
            ids = np.empty(int(ends[-1]), np.uint32)
            ids[ends - 1] = mark
            inside = np.ones(len(ids), bool)
            inside[ends - 1] = False
            ids[inside] = self.flat[np.repeat(self.start[word] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            base = self.used
            self._append(ids, np.zeros(0, np.int64))
            self.used = base + len(ids)
            self.start[at + place], self.length[at + place] = base + ends - (size + 1), size + 1

    def _marked(self, text: str) -> str | None:
        """The text with its first piece and those of its lines marked, to be cut at spaces; None if it must stay whole."""
        if any([c in text for c in self.special]):
            return None
        if OPENS in text:
            return None
        if self.cuts_lines and "\n" in text and "\r" not in text and not ("\n\n" in text and ("\n\n\n" in text or "\n\n " in text or text.endswith("\n\n"))):
            text = text.replace("\n", " \n " + OPENS)
        elif " \n " in text or text.endswith(" \n"):  # a line break that isn't taken off would pass for one that is
            return None
        return OPENS + text

    def _indexes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the pieces of all texts, END after each, and how many each text has. Arrow cuts the texts, so that only the
        distinct pieces become Python objects."""
        marked = [self._marked(t) if t else "" for t in texts]
        cut = pc.split_pattern(pa.array([m or OPENS for m in marked], pa.large_string()), " ")
        flat = cut.flatten().dictionary_encode()
        distinct = flat.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        place = np.fromiter(map(self.pieces.__getitem__, distinct), np.int64, len(distinct))
        index, counts = place[flat.indices.to_numpy()], np.diff(cut.offsets.to_numpy()).astype(np.int64)
        ends = np.cumsum(counts)
        index[ends[np.array([m is None for m in marked], bool)] - 1] = self.pieces[WHOLE]
        # an empty text has END alone, in the place of the one piece above
        empty = np.array([m == "" for m in marked], bool)
        index[ends[empty] - 1] = self.pieces[END]
        return np.insert(index, ends[~empty], self.pieces[END]), counts + ~empty

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pieces) > self.max_pieces:
            self._forget()
        index, counts = self._indexes(texts)
        self._learn()
        uses = np.bincount(index, minlength=len(self.length))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        lengths = self.length[index]
        kept = len(self.length), self.used
        if len(lengths) and lengths.min() < 0:
            index, counts = self._whole(texts, index, counts, lengths)
            lengths = self.length[index]
        total = int(lengths.sum())
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.start[index] - (ends - lengths), lengths) + np.arange(total)]
        if kept[0] != len(self.length):  # forget the whole texts again
            self.start, self.length, self.used = self.start[: kept[0]], self.length[: kept[0]], kept[1]
        text_ends = ends[np.cumsum(counts) - 1] if len(counts) else ends
        return ids, np.diff(text_ends, prepend=0)

    def _whole(self, texts, index, counts, lengths):
        """Replace the pieces of texts that hold an unsafe piece by one entry for the whole text."""
        owner = np.repeat(np.arange(len(texts)), counts)
        odd = np.unique(owner[lengths < 0])
        encoded = self.tokenizer.encode_batch_fast([texts[k] for k in odd.tolist()], add_special_tokens=False)
        at = len(self.length)
        self._append(np.concatenate([np.array(e.ids, np.uint32) for e in encoded]), np.array([len(e.ids) for e in encoded], np.int64))
        is_odd = np.zeros(len(texts), bool)
        is_odd[odd] = True
        offsets = np.cumsum(counts) - counts
        keep = ~is_odd[owner]
        last = np.zeros(len(index), bool)
        last[offsets + counts - 1] = True  # the end mark stays
        first = np.zeros(len(index), bool)
        first[offsets] = True
        index = index.copy()
        index[offsets[odd]] = at + np.arange(len(odd))
        counts = counts.copy()
        counts[odd] = 2
        return index[keep | last | first], counts


_ENCODERS: dict[tuple, Encoder] = {}


def worker_encoder(path: str | None, end_id: int = 0, max_pieces: int = 400_000) -> Encoder:
    """The encoder of this Python worker, kept between its tasks."""
    key = (path, end_id, max_pieces)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, end_id, max_pieces)
    return _ENCODERS[key]
