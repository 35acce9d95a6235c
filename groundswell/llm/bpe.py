"""Exact byte-pair encoding by backtracking over longest matches, and decoding through an offset table."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from groundswell.llm.common import map_arrow

#: Fixed values of byte-level tokenizers: the pattern that parts a text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose encoding a worker remembers, and the longest it remembers: some 60 MB a worker at most.
REMEMBERED, LONGEST = 300_000, 64
#: Places of the table of pairs that a worker fills as it meets them (8 bytes each), less one; a power of two.
PAIRS = (1 << 18) - 1


def _byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies are written: printable bytes as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairEncoder:
    """Encodes and decodes with the vocabulary of a tokenizers file (byte-level BPE, no normaliser, no prefix space).

    A token sequence is the result of merging by rank exactly if each adjacent pair is what merging makes of the two
    tokens' bytes. So the encoder takes the longest token at each place (from an Aho-Corasick automaton), steps to
    the next shorter one if it can't stand beside its left neighbour, and goes back a token if none can. Places from
    which no way leads on are marked, so that each is tried once: time is linear in the text.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        self._own = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take white space with them aren't supported")
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if t not in self._own}
        size = max([*model["vocab"].values(), *self._own.values()], default=-1) + 1
        tokens: list[bytes] = [b""] * size
        for t, b in raw.items():
            tokens[model["vocab"][t]] = b
        for t, i in self._own.items():
            tokens[i] = t.encode()
        self.tokens = tokens
        ids = {b: model["vocab"][t] for t, b in raw.items()}
        # rank of a token: that of the merge that makes it; single bytes come before all merges
        self._rank, self._made, self._parts = {}, {}, {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (ids[raw[x]] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = ids[tokens[left] + tokens[right]]
            self._made[left, right] = (rank, whole)
            if whole not in self._parts:
                self._parts[whole], self._rank[whole] = (left, right), rank
        self._byte = {b[0]: i for b, i in ids.items() if len(b) == 1}
        # A token that merging never makes of its own bytes can't be in a result.
        self._usable = {i for i in self._byte.values()} | {i for i in self._parts if self._stands(i)}
        self._automaton = ahocorasick.Automaton()
        usable = {tokens[i]: i for i in self._usable}
        for b, i in usable.items():
            self._automaton.add_word(b.decode("latin-1"), (len(b), i))
        self._automaton.make_automaton()
        self._shorter = {i: next((usable[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in usable), -1) for b, i in usable.items()}
        # the pair-compatibility table: at a pair's place, the pair last looked up there and its answer
        self._pairs = array("q", [-1]) * (PAIRS + 1)
        self._special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self._own, key=len, reverse=True)) + ")") if self._own else None
        self._pieces = regex.compile(PIECES)
        # decoding: token i's bytes are blob[offsets[i]:offsets[i + 1]]
        self._offsets = np.concatenate([[0], np.cumsum([len(b) for b in tokens])]).astype(np.int64)
        self._blob = np.frombuffer(b"".join(tokens), np.uint8)
        self._written = [str(i) for i in range(size)]
        self._known: dict[str, str] = {}

    def _stands(self, token: int) -> bool:
        left, right = self._parts[token]
        return self._tree_ok(left) and self._tree_ok(right) and self._compatible(left, right, self._rank[token])

    def _tree_ok(self, token: int) -> bool:
        return token not in self._parts or self._stands_known(token)

    def _stands_known(self, token: int) -> bool:
        known = self.__dict__.setdefault("_standing", {})
        if token not in known:
            known[token] = self._stands(token)
        return known[token]

    def _compatible(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether merging leaves the border between two tokens alone (up to the merge of rank ``before``).

        Undoing merges from the highest rank down shows which tokens meet at the border at each time; the border
        falls if one of those pairs has a merge that comes before either is built up further."""
        limit = len(self._made) if before is None else before
        while True:
            merge = self._made.get((left, right))
            if merge is not None and merge[0] < limit:
                return False
            rank_left, rank_right = self._rank.get(left, -1), self._rank.get(right, -1)
            if rank_left < 0 and rank_right < 0:
                return True
            # The later of the two merges is undone. Until then, the pair inside it met: a border merge of the same
            # rank as the right token's own merge would have come first, from the left.
            if rank_left > rank_right:
                limit, left = rank_left, self._parts[left][1]
            else:
                limit, right = rank_right + 1, self._parts[right][0]

    def _fits(self, left: int, right: int) -> bool:
        pair, place = left << 24 | right, (left * 0x9E3B + right) & PAIRS
        seen = self._pairs[place]
        if seen >> 1 == pair:
            return bool(seen & 1)
        found = self._compatible(left, right)
        self._pairs[place] = pair << 1 | found
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        n = len(data)
        longest = [-1] * n
        best = [0] * n
        for end, (size, token) in self._automaton.iter(data.decode("latin-1")):
            start = end - size + 1
            if size > best[start]:
                best[start], longest[start] = size, token
        out: list[int] = []
        open_at = bytearray(b"\1") * (n + 1)
        at, token = 0, longest[0] if n else -1
        tokens, shorter = self.tokens, self._shorter
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(tokens[token])
                if open_at[end] and (last < 0 or self._fits(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                open_at[at] = 0
                token = out.pop()
                at -= len(tokens[token])
                token = shorter[token]
        return out

    def _piece(self, piece: str) -> str:
        """A piece's ids as decimal numbers joined by commas; those of one token share one string."""
        ids = self.encode_piece(piece.encode())
        found = self._written[ids[0]] if len(ids) == 1 else ",".join([self._written[i] for i in ids])
        if len(piece) <= LONGEST:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[piece] = found
        return found

    def digest(self, text: str) -> tuple[np.ndarray, bytes]:
        """The ids of a text, and their decimal numbers joined by commas.

        Added tokens' strings are found first, as the library does by default."""
        known, out = self._known, []
        parts = self._special.split(text) if self._special is not None else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self._written[self._own[part]])
            else:
                out += [known.get(piece) or self._piece(piece) for piece in self._pieces.findall(part)]
        written = ",".join(out)
        return np.fromstring(written, np.int32, sep=",") if written else np.zeros(0, np.int32), written.encode()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        return self.digest(text)[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: each token's bytes are gathered through the offset table; bytes that aren't UTF-8 become U+FFFD."""
        if not len(ids):
            return ""
        first = self._offsets[ids]
        sizes = self._offsets[ids.astype(np.int64) + 1] - first
        ends = np.cumsum(sizes)
        index = np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)
        return self._blob[index].tobytes().decode("utf-8", "replace")


_encoders: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """One encoder a worker and vocabulary: loading takes about a second, and its memory of pieces is shared."""
    if path not in _encoders:
        _encoders[path] = BytePairEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str, *, keep: tuple[str, ...] = (), ids: bool = True) -> DataFrame:
    """The columns ``keep`` of ``docs`` and n_tokens, ids_sha256, decoded_sha256 (of the decoded text), and with ``ids`` token_ids.

    Every whole text is encoded; null counts as empty: no tokens, and the digest of nothing. Rows are handled one by
    one where they are read, so nothing is shuffled, no key can be hot, and a lost executor costs its tasks alone.
    The vocabulary file has to lie at ``path`` on every executor. Repeated rows give repeated results; an empty
    table gives an empty one; columns besides ``text`` and ``keep`` aren't read.
    """
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["token_ids array<int>"] * ids)
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = encoder(path), hashlib.sha256
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counts, digests, decoded, all_ids = [], [], [], []
                for text in part.column(part.num_columns - 1):
                    found, written = bpe.digest(text.as_py() or "")
                    counts.append(len(found))
                    digests.append(sha(written).hexdigest())
                    decoded.append(sha(bpe.decode(found).encode()).hexdigest())
                    if ids:
                        all_ids.append(found)
                columns = [part.column(i) for i in range(len(keep))] + [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*all_ids, np.zeros(0, np.int32)]))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(docs.select(*keep, docs["text"].alias("_text")), run, schema)
