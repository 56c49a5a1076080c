"""BPE encoding by speculation and verification, and decoding.

Words are proposed as the greedy longest vocabulary match.  A proposal is the true BPE result exactly
when every token encodes to itself and no merge could have crossed the border of any adjacent pair while
the two tokens were being built.  The border test runs over all pairs of all new words of a batch at
once in numpy; only words that fail are merged exactly, rank by rank.  Short words are proposed and merged
side by side in numpy, longer ones alone.

Contract for odd input: a null or empty text has no tokens; texts of any length are encoded whole;
repeated rows give repeated rows; other columns of the input are never read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweave.llm.common import give_back, small_batches, typed, worded

WORD_END = "</w>"
#: Letters whose class and small form every Unicode version since 6 gives alike; a text with others is
#: normalised and cut into words by the tokenizers library, as versions differ on newer letters.
SETTLED = regex.compile(r"[\x00-\u052f\u1e00-\u1eff\u2000-\u2064\u20a0-\u20b8\u2190-\u23e8\u2500-\u26cd\u3000-\u3096\u30a0-\u30fe\u4e00-\u9fcb\uac00-\ud7a3\ufffd]*+")
#: Words remembered by a worker; beyond that it forgets those not met since it learnt half as many.
CACHE_WORDS = 300_000
#: Letters of the longest words that are merged side by side, and words of such a turn.
SHORT, TURN = 48, 8_000
NEVER = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def plain_pattern(pattern: str) -> re.Pattern[str]:
    """A pattern for texts of the basic plane, its properties of letters, digits and spaces written out.

    What has a property is asked of ``regex``; ``re`` then finds the same words in less time.  They stand
    inside brackets in the pattern.
    """
    plane = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x10000)))
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        runs = [f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(f"{name}+", plane)]
        pattern = pattern.replace(name, "".join(runs))
    return re.compile(pattern)


class WordBpe:
    """A word-level BPE with an end-of-word mark, read from a tokenizer's JSON text."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        model = parsed["model"]
        self.ids: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        names = {i: s for s, i in [*self.ids.items(), *added.items()]}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.added = {s: np.uint32(i).tobytes() for s, i in added.items()}
        self.cut_added = regex.compile("(" + "|".join(sorted(map(regex.escape, added), key=len, reverse=True)) + ")")
        self.words = plain_pattern(parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.library = Tokenizer.from_str(spec)
        self.grow_trie()
        # Letters of the longest token by its first four.
        self.reach: dict[str, int] = {}
        for s in self.ids:
            if (k := len(s.removesuffix(WORD_END))) > 3:
                self.reach[s[:4]] = max(k, self.reach.get(s[:4], 4))

        n = len(self.names)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[tuple[str, str], int] = {m: r for r, m in enumerate(merges)}
        # By id: the rank that makes a token (-1: a single letter) and its two halves.
        self.made_at = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        keys = np.empty(len(merges), np.int64)
        self.made = np.empty(len(merges), np.int64)
        for r, (a, b) in enumerate(merges):
            t, i, j = self.ids[a + b], self.ids[a], self.ids[b]
            keys[r], self.made[r] = i << 32 | j, t
            if self.made_at[t] < 0:
                self.made_at[t], self.left[t], self.right[t] = r, i, j
        self.key_rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.key_rank]
        self.inner = np.array([self.ids[c] for c in self.letters])
        self.last = np.array([self.ids[c + WORD_END] for c in self.letters])
        # Ids of words met lately, and of added tokens by their id's bytes.
        self.cache: dict[str | bytes, bytes] = {}
        self.older: dict[str | bytes, bytes] = {}
        self.whole: dict[int, bool] = {}
        self.merged_exactly = 0

    def symbols(self, word: str) -> str:
        return "".join(map(self.letters.__getitem__, word.encode()))

    def grow_trie(self) -> None:
        """Steps from node to node by byte, and the tokens that end in a node: inside a word, and at its end."""
        step: dict[int, int] = {}
        ends: dict[int, list[int]] = {0: [-1, -1]}
        for s, i in self.ids.items():
            last = s.endswith(WORD_END) and s != WORD_END
            node = 0
            for c in s.removesuffix(WORD_END) if last else s:
                node = step.setdefault(node << 8 | self.byte_of[c], len(step) + 1)
            ends.setdefault(node, [-1, -1])[last] = i
        self.steps = np.array(sorted(step))
        self.step_to = np.array([step[k] for k in self.steps.tolist()])
        self.ends = np.full((len(step) + 1, 2), -1)
        self.ends[list(ends)] = list(ends.values())

    def propose_side_by_side(self, letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`propose` of many short words, laid end to end: the tokens in order, and how many a word has."""
        end = np.cumsum(sizes)
        at, word = end - sizes, np.arange(len(sizes))
        node, best, best_end = np.zeros(len(sizes), np.int64), np.full(len(sizes), -1), at.copy()
        found, holder, start = [], [], []
        while len(word):
            want = node << 8 | letters[np.minimum(at, end - 1)]
            k = np.minimum(np.searchsorted(self.steps, want), len(self.steps) - 1)
            on = (self.steps[k] == want) & (at < end)
            node = np.where(on, self.step_to[k], 0)
            at = at + on
            token = self.ends[node, (at == end).astype(np.int64)]
            fits = on & (token >= 0)
            best, best_end = np.where(fits, token, best), np.where(fits, at, best_end)
            # Where no longer token can be, the best one stands and the next begins behind it.
            off = ~on
            found.append(best[off])
            holder.append(word[off])
            start.append(best_end[off])
            at = np.where(off, best_end, at)
            go = ~(off & (best_end == end))
            at, end, word, node, best, best_end = at[go], end[go], word[go], node[go], best[go], best_end[go]
        found, holder, start = map(np.concatenate, (found, holder, start))
        return found[np.argsort(start)], np.bincount(holder, minlength=len(sizes))

    def propose(self, letters: str) -> list[int]:
        """Greedy longest match from the left; the last token carries the end mark."""
        out, at, end = [], 0, len(letters)
        while at < end:
            stop = min(end, at + self.reach.get(letters[at : at + 4], 3))
            while (i := self.ids.get(letters[at:stop] + WORD_END * (stop == end))) is None:
                stop -= 1
            out.append(i)
            at = stop
        return out

    def merge(self, letters: str) -> list[int]:
        """Exact merging: lowest rank first, leftmost among equals."""
        parts = [*letters[:-1], letters[-1] + WORD_END]
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j < 0 or not parts[i] or self.rank.get((parts[i], parts[j])) != r:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (m := after[k]) >= 0 and (r := self.rank.get((parts[k], parts[m]))) is not None:
                    heapq.heappush(heap, (r, k))
        return [self.ids[p] for p in parts if p]

    def merge_side_by_side(self, words: list[str]) -> list[bytes]:
        """:meth:`merge` of many short words: every turn does one merge in each word that has one left."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        wide = int(sizes.max(initial=1))
        ids = np.full((len(raw), wide), -1)
        held = np.arange(wide) < sizes[:, None]
        letters = np.frombuffer(b"".join(raw), np.uint8)
        ids[held] = self.inner[letters]
        row = np.arange(len(raw))
        ids[row, sizes - 1] = self.last[letters[np.cumsum(sizes) - 1]]
        ranks = np.full((len(raw), wide), NEVER)
        pairs = held[:, 1:]
        ranks[:, :-1][pairs] = self.pair_rank(ids[:, :-1][pairs], ids[:, 1:][pairs])
        left = sizes.copy()
        live = row
        while len(live):
            mine = ranks[live]
            at = mine.argmin(axis=1)  # the leftmost of equals
            more = mine[np.arange(len(live)), at] < NEVER
            live, at = live[more], at[more]
            if not len(live):
                break
            ids[live, at] = self.made[ranks[live, at]]
            left[live] -= 1
            # What stands after the pair moves up by one place.
            shift = np.arange(wide - 1)[None, :] > at[:, None]
            part = ids[live]
            ids[live, :-1] = np.where(shift, part[:, 1:], part[:, :-1])
            part = ranks[live]
            ranks[live, :-1] = np.where(shift, part[:, 1:], part[:, :-1])
            for k in (at - 1, at):
                fits = k >= 0
                r, k = live[fits], k[fits]
                ranks[r, k] = np.where(k + 1 < left[r], self.pair_rank(ids[r, k], ids[r, np.minimum(k + 1, wide - 1)]), NEVER)
        out, ends = ids[np.arange(wide) < left[:, None]].astype("<u4").tobytes(), (4 * np.cumsum(left)).tolist()
        return [out[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def is_whole(self, token: int) -> bool:
        """Whether a token's own letters merge back into that one token."""
        if (known := self.whole.get(token)) is None:
            name = self.names[token]
            ends = name.endswith(WORD_END) and name != WORD_END
            if ends:
                known = self.merge(name.removesuffix(WORD_END)) == [token]
            else:  # merged as an inner piece: no end mark on its last letter
                known = self.merge_inner(name) == [token]
            self.whole[token] = known
        return known

    def merge_inner(self, letters: str) -> list[int]:
        parts = list(letters)
        while len(parts) > 1:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ids[p] for p in parts]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.key_rank[at], NEVER)

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair: no merge crosses the border while both tokens are built.

        Walks both tokens back in time.  At any moment one piece of ``a`` and one of ``b`` touch; a
        crossing merge of rank m happens if it comes before the merge that takes the left piece into
        ``a`` and not after the one that takes the right piece into ``b`` (equal ranks: leftmost first).
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        until_a, until_b = np.full(len(a), NEVER - 1), np.full(len(a), NEVER - 1)
        while len(live):
            m = self.pair_rank(a, b)
            bad = (m < until_a) & (m <= until_b)
            ok[live[bad]] = False
            ra, rb = self.made_at[a], self.made_at[b]
            back_b = rb >= ra
            go = ~bad & ((ra >= 0) | (rb >= 0))
            until_a = np.where(back_b, until_a, ra)[go]
            until_b = np.where(back_b, rb, until_b)[go]
            a, b = np.where(back_b, a, self.right[a])[go], np.where(back_b, self.left[b], b)[go]
            live = live[go]
        return ok

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that are new to this worker."""
        words = list(words)
        long = [w for w in words if len(w) > SHORT]
        short = [w for w in words if len(w) <= SHORT]
        for k in range(0, len(short), TURN):
            turn = short[k : k + TURN]
            raw = [w.encode() for w in turn]
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            self.settle(turn, *self.propose_side_by_side(np.frombuffer(b"".join(raw), np.uint8).astype(np.int64), sizes), self.merge_side_by_side)
        if long:
            proposed = [self.propose(self.symbols(w)) for w in long]
            flat = np.fromiter((i for p in proposed for i in p), np.int64)
            self.settle(long, flat, np.fromiter(map(len, proposed), np.int64, len(long)), lambda ws: [np.array(self.merge(self.symbols(w)), "<u4").tobytes() for w in ws])

    def settle(self, words: list[str], flat: np.ndarray, sizes: np.ndarray, merged: Callable[[list[str]], list[bytes]]) -> None:
        """Remember the proposals that stand, and what ``merged`` makes of the other words."""
        owner = np.repeat(np.arange(len(words)), sizes)
        fine = np.ones(len(words), bool)
        unit = np.unique(flat)
        broken = unit[[not self.is_whole(int(t)) for t in unit]]
        fine[owner[np.isin(flat, broken)]] = False
        inner = owner[:-1] == owner[1:]
        fine[owner[:-1][inner][~self.stay_apart(flat[:-1][inner], flat[1:][inner])]] = False
        ids, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        self.cache.update((w, ids[a:b]) for w, a, b, good in zip(words, [0, *ends], ends, fine.tolist(), strict=False) if good)
        failed = [w for w, good in zip(words, fine.tolist(), strict=True) if not good]
        self.merged_exactly += len(failed)
        if failed:
            self.cache.update(zip(failed, merged(failed), strict=True))

    def split(self, text: str) -> list[str | bytes]:
        """Words of the normalised text; added tokens stand as their id's bytes."""
        out: list[str | bytes] = []
        parts = self.cut_added.split(text) if "<|" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.added[part])
            elif part:
                if not part.isascii():
                    if not SETTLED.fullmatch(part):
                        out += self.split_by_library(part)
                        continue
                    # one letter at a time: a capital sigma has one small form here
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                out += self.words.findall(part.lower())
        return out

    def split_by_library(self, part: str) -> list[str | bytes]:
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(map(self.byte_of.__getitem__, letters)).decode() for letters, _ in found]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS // 2:
            self.cache, self.older = {}, self.cache
        new = set().union(*split).difference(self.cache)
        met = new & self.older.keys()
        self.cache.update((w, self.older[w]) for w in met)
        self.cache.update((w, w) for w in new if w.__class__ is bytes)
        self.learn(w for w in new - met if w.__class__ is str)
        return [b"".join(map(self.cache.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """Tokens by name, parted by spaces: the decoding of a tokenizer without a decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def tokenizer_spec(path: str) -> str:
    """The tokenizer file's text, read on the driver; executors get it with the task."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_READY: dict[int, WordBpe] = {}


def _ready(spec: str) -> WordBpe:
    key = hash(spec)
    if key not in _READY:
        _READY.clear()
        _READY[key] = WordBpe(spec)
    return _READY[key]


def encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``carry`` columns, ``n_tokens``, ``ids`` (binary, little-endian 32-bit), ``decoded``.

    The vocabulary (under 2 MB, fixed by its file) is broadcast; there is no shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    cols = [id_col, *carry]
    plain = docs.select(*cols, F.col(text_col).alias("__text"))
    kept = worded(plain, *cols)
    schema = ", ".join([*(f"`{c}` string" for c in cols), "n_tokens bigint, ids binary, decoded string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _ready(shared.value)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                ids = bpe.encode_batch([t if isinstance(t, str) else None for t in part["__text"]])
                yield part.drop(columns="__text").assign(n_tokens=[len(b) // 4 for b in ids], ids=ids, decoded=[bpe.decode(b) for b in ids])
        give_back()

    return typed(small_batches(kept).mapInPandas(run, schema), plain, *cols)


def encode_digest(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digests of :func:`encode`'s columns."""
    return encode(docs, spec, id_col, text_col).select(
        id_col,
        "n_tokens",
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_digest(docs, tokenizer_spec(path or default_tokenizer()))
