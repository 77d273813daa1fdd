"""Byte-level BPE encoding and decoding with a pair occurrence index over a partition's words."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import fresh, query, table

# Fixed value: the word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Words remembered between texts, characters of new words merged at once, and the longest
# word that is remembered: bounds on a task's memory that do not change the result.
REMEMBER = 150_000
TOGETHER = 1 << 20
LONGEST = 64
NONE = -1


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """A tokenizer file's vocabulary and merges. Encodes batches of words with one index of pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.of_byte = np.array([vocab[c] for c in letters], dtype=np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        a = np.array([vocab[x] for x, _ in merges], dtype=np.int64)
        b = np.array([vocab[y] for _, y in merges], dtype=np.int64)
        self.new = np.array([vocab[x + y] for x, y in merges], dtype=np.int64)
        self.a, self.b = a.tolist(), b.tolist()
        codes = (a << 32) | b
        order = np.argsort(codes, kind="stable")
        self.codes, self.rank_of = codes[order], order
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(value[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.digits = [str(i) for i in range(max(self.bytes_of) + 1)]
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.word_at = regex.compile(PATTERN)
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or NONE."""
        code = (left << 32) | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (left >= 0) & (right >= 0), self.rank_of[at], NONE)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of every word.

        All words stand in one array of symbols. The index holds for each pair that has a
        rank the positions where it stands; the lowest rank is applied at all its
        positions at once, and the pairs this makes left and right are added to their
        lists. A listed position where the pair is gone meanwhile is passed over. Every
        merge makes a token of its own, so a new pair's rank is above the applied one and
        ranks are taken in ascending order.
        """
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        n = len(data)
        word = np.repeat(np.arange(len(words)), lengths)
        # Position n stands for "outside the word".
        sym = np.append(self.of_byte[data], NONE)
        at = np.arange(n)
        nxt = np.append(np.where(np.append(word[1:] != word[:-1], True)[:n], n, at + 1), n)
        prv = np.append(np.where(np.append(True, word[1:] != word[:-1])[:n], n, at - 1), n)
        rank = self._ranks(sym[at], sym[nxt[at]])
        listed = np.flatnonzero(rank >= 0)
        order = listed[np.argsort(rank[listed], kind="stable")]
        ranks, starts = np.unique(rank[order], return_index=True)
        index: dict[int, list] = {int(r): [p] for r, p in zip(ranks, np.split(order, starts[1:]))}
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            p = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            a, b = self.a[r], self.b[r]
            p = p[(sym[p] == a) & (sym[nxt[p]] == b)]
            if a == b and len(p) > 1:
                p = self._apart(p, nxt)
            if not len(p):
                continue
            gone = nxt[p]
            after = nxt[gone]
            sym[p] = self.new[r]
            sym[gone] = NONE
            nxt[p] = after
            prv[after] = p
            nxt[n] = prv[n] = n
            before = prv[p]
            left = np.concatenate([before, p])
            new = self._ranks(sym[left], np.concatenate([sym[p], sym[after]]))
            got = np.flatnonzero(new >= 0)
            if not len(got):
                continue
            new, left = new[got], left[got]
            if len(got) > 1:
                by = np.argsort(new, kind="stable")
                new, left = new[by], left[by]
                cuts = np.flatnonzero(new[1:] != new[:-1]) + 1
                groups = zip(new[np.append(0, cuts)].tolist(), np.split(left, cuts)) if len(cuts) else [(int(new[0]), left)]
            else:
                groups = [(int(new[0]), left)]
            for k, places in groups:
                if k in index:
                    index[k].append(places)
                else:
                    index[k] = [places]
                    heapq.heappush(heap, k)
        alive = np.flatnonzero(sym[:n] >= 0)
        ends = np.searchsorted(alive, np.cumsum(lengths))
        ids = sym[alive].tolist()
        return [ids[i:j] for i, j in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())] if len(words) else []

    @staticmethod
    def _apart(p: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """Of positions of a pair of two like symbols, those a scan from the left takes."""
        p = np.sort(p)
        kept, taken = [], NONE
        for i, follows in zip(p.tolist(), nxt[p].tolist()):
            if i != taken:
                kept.append(i)
                taken = follows
        return np.array(kept, dtype=np.int64)

    def _learn(self, words: Iterable[str]) -> dict[str, tuple[str, int, bytes]]:
        """(ids joined by commas, number of ids, decoded bytes) of words not yet known."""
        out, batch, size = {}, [], 0
        digits, decoded = self.digits.__getitem__, self.bytes_of.__getitem__

        def settle():
            for w, ids in zip(batch, self.merge([x.encode() for x in batch])):
                out[w] = (",".join(map(digits, ids)), len(ids), b"".join(map(decoded, ids)))

        for w in words:
            batch.append(w)
            size += len(w)
            if size >= TOGETHER:
                settle()
                batch, size = [], 0
        if batch:
            settle()
        return out

    def pieces(self, text: str) -> list[str]:
        """Words of a text; a special token's string is a piece of its own."""
        if self.special_at is None or not self.special_at.search(text):
            return self.word_at.findall(text)
        out = []
        for i, part in enumerate(self.special_at.split(text)):
            out.extend([part] if i % 2 else self.word_at.findall(part))
        return out

    def _table(self, words: set[str]) -> dict[str, tuple[str, int, bytes]]:
        new = [w for w in words if w not in self.known and w not in self.special]
        learned = self._learn(new)
        found = self.known
        if len(found) + len(learned) > REMEMBER:
            found = {w: found[w] for w in words if w in found}
        found.update(learned)
        found.update((t, (str(i), 1, self.bytes_of[i])) for t, i in self.special.items())
        self.known = {w: v for w, v in found.items() if len(w) <= LONGEST} if len(found) > REMEMBER else found
        return found

    def encode(self, texts: list[str]) -> list[tuple[list[str], list[int], str]]:
        """Per text: its words' comma-joined ids, their counts, and the text decoded from the ids."""
        cut = [self.pieces(t) for t in texts]
        found = self._table({w for words in cut for w in words})
        out = []
        for words in cut:
            ids, counts, raw = zip(*[found[w] for w in words]) if words else ((), (), ())
            out.append((ids, counts, b"".join(raw).decode("utf-8", "replace")))
        return out


_LOADED: dict[str, Bpe] = {}


def tokenizer(path: str) -> Bpe:
    """One tokenizer a worker process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def runs(texts: Iterable[str | None], limit: int = 1 << 22):
    """Lists of texts of about ``limit`` characters; NULL is empty."""
    run, size = [], 0
    for t in texts:
        t = t or ""
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "bpe", with_ids: bool = True) -> DataFrame:
    """``docs`` with a struct ``out``: ids (if ``with_ids``), n_tokens, ids_sha256, decoded, decoded_sha256.

    ``path`` is the tokenizer file, present on every executor. Special tokens' strings in a
    text become their ids, none are added. NULL and empty texts have no ids. ids_sha256 is
    the digest of the decimal ids joined by commas. ``decoded`` (if ``with_ids``) and its
    digest are of the text made from the ids. Every row is encoded on its own, so there is
    no shuffle; repeated rows repeat, other columns stay.
    """
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    @F.pandas_udf(fields)
    def run(texts: pd.Series) -> pd.DataFrame:
        bpe, rows = tokenizer(path), []
        for part in runs(texts):
            for joined, counts, decoded in bpe.encode(part):
                ids = ",".join(joined)
                row = [sum(counts), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                rows.append(row + [np.array(ids.split(",") if ids else [], dtype=np.int32), decoded] * with_ids)
        return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in fields.split(", ")])

    return docs.withColumn(out, run(F.col(text)))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of the array ``ids``; NULL ids give NULL, malformed bytes U+FFFD."""

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        of = tokenizer(path).bytes_of
        return lists.map(lambda x: None if x is None else b"".join(of[int(i)] for i in x).decode("utf-8", "replace"))

    return rows.withColumn(out, run(F.col(ids)))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The public file's place on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(docs: DataFrame, path: str) -> DataFrame:
    out = fresh(docs, "bpe")
    done = encode(docs, path, out=out, with_ids=False)
    return done.select("doc_id", f"{out}.n_tokens", f"{out}.ids_sha256", f"{out}.decoded_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: a row for every document, with its ids' and its decoded text's digests."""
    return digests(docs, vocabulary())


@query("op9_bpe_digests")
def op9(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), vocabulary())
