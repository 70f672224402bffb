"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It accepts exactly the token sequences that BPE gives for their text, so a word has one
accepted path, and the arcs' labels along it are its tokens.

Construction, by successive merge gadgets. At first one state carries an arc to itself for every base symbol. The gadget
of a merge (u, v) -> w looks at the state q that u's arcs enter: if v leaves q, u's arcs are led to a copy of q without
v, and w gets an arc from every state that has u's arc, into the state that v's arcs enter. So a token's arcs always enter
one state, which makes the automaton deterministic.

Table. A plain table of states by tokens would have about 49,000 x 49,000 entries, so it is kept row by row as in other
large automata: a row holds the arcs that its gadgets took away (with the number of the merge), and a default row, that of
the state from which it was copied, says the rest as it was then. Likewise an arc w that a merge made leaves a state if u
did at that time, so a column defaults to u's. The whole table is compiled when the vocabulary is loaded; nothing is added
while encoding. A transition is looked up in the rows along both chains of defaults, three or four each.

Encoding follows the table through a word; the accepted path up to each position is unique, as BPE of that prefix is, so
the search enters a position once at most. Of each piece of text only the distinct words pass the automaton, all of them
in step, an array operation for each transition; ids and labels are then gathered by the words' numbers.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .shingles import slices

_NEVER = 1 << 60
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: White space of the normaliser, and what a word that begins with an apostrophe is cut into first.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SHORT = ("s", "t", "re", "ve", "m", "ll", "d")
#: Words that are still on their way when so few are left go on one by one.
_FEW = 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Lookup:
    """Numbers by integer keys: open addressing in arrays, asked for many keys at once; -1 stands for a missing key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 6).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        on = np.flatnonzero((there != keys) & (there >= 0))
        slot = slot[on]
        while len(on):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == keys[on]
            out[on[hit]] = self.values[slot[hit]]
            more = ~hit & (there >= 0)
            on, slot = on[more], slot[more]
        return out


class Automaton:
    """Compiled from the texts of tokens (tuples of base symbols below 512) and ordered merges of token numbers (u, v, w)."""

    def __init__(self, texts: dict[int, tuple[int, ...]], merges: list[tuple[int, int, int]]):
        n = max(texts) + 1
        #: For a token that a merge made: its parts, and the number of the merge.
        self.left, self.right, self.born = [-1] * n, [-1] * n, [-1] * n
        #: Own rows: of the state that a token's arcs enter, the arcs taken away and the merge that took each.
        self.taken: list[dict[int, int] | None] = [None] * n
        made = {w for _, _, w in merges}
        ready = {t for t in texts if t not in made}
        for k, (u, v, w) in enumerate(merges):
            if not self.leaves(u, v):
                continue  # the pair never stands side by side when this merge has its turn
            if self.taken[u] is None:
                self.taken[u] = {}
            self.taken[u][v] = k
            if w not in ready:
                self.left[w], self.right[w], self.born[w] = u, v, k
                ready.add(w)
        self.ready = ready
        #: The tokens' texts as a tree of symbols: step gives the next node, token_of the token that ends at a node.
        self.step: dict[int, int] = {}
        self.token_of = [-1]
        self.shorter, self.spans = [-1] * n, [0] * n
        for t in sorted(ready, key=lambda t: len(texts[t])):
            node, best = 0, -1
            for symbol in texts[t]:
                best = max(best, self.token_of[node], key=lambda x: self.spans[x] if x >= 0 else -1)
                key = node << 9 | symbol
                if key not in self.step:
                    self.step[key] = len(self.token_of)
                    self.token_of.append(-1)
                node = self.step[key]
            #: shorter: the longest token that this one begins with, or -1.
            self.token_of[node], self.shorter[t], self.spans[t] = t, best, len(texts[t])
        self._arrays()

    def _arrays(self) -> None:
        """The same table as arrays, for many words in step."""
        rows = [(u << 20 | v, k) for u, row in enumerate(self.taken) if row for v, k in row.items()]
        self._taken = Lookup(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32))
        self._step = Lookup(np.fromiter(self.step, np.int64), np.fromiter(self.step.values(), np.int32))
        as_array = lambda x: np.array(x, np.int64)
        self._left, self._right, self._born, self._spans, self._shorter, self._token_of = map(as_array, (self.left, self.right, self.born, self.spans, self.shorter, self.token_of))
        self._has_row = np.array([bool(r) for r in self.taken])
        self._ever_taken = np.zeros(len(self.left), bool)
        self._ever_taken[as_array([r[0] & (1 << 20) - 1 for r in rows])] = True

    def leaves(self, before: int, token: int) -> bool:
        """The table's entry: whether token's arc leaves the state that before's arcs enter.

        Rows: before's own, then that of its second part as it was when before was made, and so on. Columns: token's, then
        that of its first part as it was when token was made."""
        taken, left, right, born = self.taken, self.left, self.right, self.born
        cut = _NEVER
        while before >= 0:
            row = taken[before]
            if row is not None:
                t, until = token, cut
                while t >= 0:
                    k = row.get(t)
                    if k is not None and k < cut and k <= until:
                        return False
                    until, t = born[t], left[t]
            if born[before] < cut:
                cut = born[before]
            before = right[before]
        return True

    def leave(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The table's entries for many pairs, like `leaves`."""
        out = np.ones(len(before), bool)
        at, row, cut = np.arange(len(before)), before, np.full(len(before), _NEVER)
        while len(at):
            own = self._has_row[row]
            i, r, c, t = at[own], row[own], cut[own], token[at[own]]
            until = c
            while len(i):
                asked = self._ever_taken[t]
                k = np.full(len(i), -1, np.int64)
                k[asked] = self._taken.get(r[asked] << 20 | t[asked])
                gone = (k >= 0) & (k < c) & (k <= until)
                out[i[gone]] = False
                until, t = self._born[t], self._left[t]
                on = (t >= 0) & ~gone
                i, r, c, t, until = i[on], r[on], c[on], t[on], until[on]
            cut, row = np.minimum(cut, self._born[row]), self._right[row]
            on = (row >= 0) & out[at]
            at, row, cut = at[on], row[on], cut[on]
        return out

    def longest(self, symbols: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The longest token at each of these places that does not go beyond the word's end."""
        out, i, node = np.full(len(at), -1, np.int64), np.arange(len(at)), np.zeros(len(at), np.int64)
        while len(i):
            node = self._step.get(node << 9 | symbols[at]).astype(np.int64)
            token = np.where(node >= 0, self._token_of[node], -1)
            out[i[token >= 0]] = token[token >= 0]
            at = at + 1
            on = (node >= 0) & (at < ends)
            i, node, at, ends = i[on], node[on], at[on], ends[on]
        return out

    def words(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of many words, given by their symbols and n + 1 offsets: all tokens, and n + 1 offsets into them.

        The words go in step, each as in `word`; as the way to a position is unique, the token that led there and whether
        it is closed are kept by position."""
        n = len(offsets) - 1
        w = np.flatnonzero(offsets[1:] > offsets[:-1])
        at, ends = offsets[w], offsets[w + 1]
        into, closed = np.full(len(symbols) + 1, -1, np.int64), np.zeros(len(symbols) + 1, bool)
        token, last = self.longest(symbols, at, ends), np.full(len(w), -1, np.int64)
        while len(w) > _FEW:
            able = token >= 0
            to = at + self._spans[token]
            able &= ~closed[np.where(able, to, 0)]
            asked = np.flatnonzero(able & (last >= 0))
            able[asked] = self.leave(last[asked], token[asked])
            into[to[able]] = token[able]
            back = np.flatnonzero(token < 0)
            if len(back):
                closed[at[back]] = True
                led = last[back]
                at[back] -= self._spans[led]
                token[back] = led  # its next shorter one is tried below
                last[back] = np.where(at[back] > offsets[w[back]], into[at[back]], -1)
            at, last, token = np.where(able, to, at), np.where(able, token, last), np.where(able, token, self._shorter[token])
            on = at < ends
            w, at, ends, last, token, able = w[on], at[on], ends[on], last[on], token[on], able[on]
            fresh = np.flatnonzero(able)
            token[fresh] = self.longest(symbols, at[fresh], ends[fresh])
        for x in w.tolist():
            place = offsets[x]
            for t in self.word(symbols[place : offsets[x + 1]].tolist()):
                place += self.spans[t]
                into[place] = t
        # Read the paths from the words' ends.
        w = np.flatnonzero(offsets[1:] > offsets[:-1])
        place, counts = offsets[w + 1], np.zeros(n, np.int64)
        used = np.zeros(len(symbols) + 1, bool)
        while len(w):
            used[place] = True
            counts[w] += 1
            place = place - self._spans[into[place]]
            on = place > offsets[w]
            w, place = w[on], place[on]
        return into[used], np.concatenate([[0], np.cumsum(counts)])

    def word(self, symbols: list[int]) -> list[int]:
        """The arcs' labels on the one accepted path of a word.

        Longer tokens are tried first. A position that can't be left again is closed: it had one way in, as the path to
        each position is unique, so each position is entered once."""
        step, token_of, shorter, spans, leaves = self.step, self.token_of, self.shorter, self.spans, self.leaves
        n = len(symbols)
        path: list[int] = []
        closed: set[int] = set()
        at, last, t = 0, -1, None
        while at < n:
            if t is None:
                node = 0
                for i in range(at, n):
                    node = step.get(node << 9 | symbols[i], -1)
                    if node < 0:
                        break
                    if token_of[node] >= 0:
                        t = token_of[node]
            while t >= 0:
                if at + spans[t] not in closed and (last < 0 or leaves(last, t)):
                    break
                t = shorter[t]
            if t >= 0:
                path.append(t)
                at, last, t = at + spans[t], t, None
            else:
                closed.add(at)
                back = path.pop()
                at -= spans[back]
                last, t = path[-1] if path else -1, shorter[back]
        return path


def classes() -> np.ndarray:
    """Of each code point whether it is white space, a letter, a number or something else."""
    out = np.full(0x110000, _OTHER, np.uint8)
    points = np.arange(0x110000, dtype="<u4")
    every = points[(points < 0xD800) | (points >= 0xE000)].tobytes().decode("utf-32-le")
    for form, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
        for m in regex.finditer(form, every):
            out[ord(m.group()[0]) : ord(m.group()[-1]) + 1] = kind  # no run goes over the surrogates
    out[_SPACES] = _SPACE
    return out


def cut_words(points: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in a text's code points: runs of letters, single numbers, runs of other characters, and
    the short forms behind an apostrophe that is not inside a run of others."""
    kind = kinds[points]
    begins = np.ones(len(points), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    marks = np.flatnonzero((points == 0x27) & begins)
    if len(marks):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        for form in _SHORT:
            fits = marks[np.logical_and.reduce([padded[marks + 1 + i] == ord(c) for i, c in enumerate(form)])]
            begins[fits + 1] = False
            after = fits + 1 + len(form)
            begins[after[after < len(points)]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(points))
    real = kind[starts] != _SPACE
    return starts[real], ends[real]


class WordBpe:
    """A tokenizer file of the kind: normalise, split into words, byte-level BPE with a mark at word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        number = {c: i for i, c in enumerate(byte_symbols())}
        made = {w for _, _, w in merges}
        texts = {i: self._symbols(t, number) for t, i in vocab.items()}
        self.automaton = Automaton({i: x for i, x in texts.items() if x and (i in made or len(x) == 1)}, merges)
        missing = [s for s in range(512 if self.end else 256) if s not in self.automaton.step]
        if missing:
            raise ValueError(f"the vocabulary lacks base symbols, such as {missing[0]}")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        #: Labels by id, each with the space that parts it from the next one.
        self.labels = pa.array([f"{labels[i]} " if i in labels else "" for i in range(max(labels) + 1)], pa.large_string())
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.kinds = classes()

    def _symbols(self, token: str, number: dict[str, int]) -> tuple[int, ...]:
        """A token's bytes; the last one of a word, with the end mark, is 256 higher. Empty for what is no such text."""
        last = bool(self.end) and token.endswith(self.end)
        body = token[: -len(self.end)] if last else token
        if not body or any(c not in number for c in body):
            return ()
        found = [number[c] for c in body]
        return (*found[:-1], found[-1] + 256 * last)

    def _plain(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Each character is lower-cased alone, so there is no final sigma.
        return text.replace("Σ", "σ").lower()

    def normalise(self, text: str) -> str:
        """The text in lower case; a special token stands as S and a character of its number, as nothing else there does."""
        if "<" not in text or not any(x in text for x in self.special):
            return self._plain(text)
        parts, at = [], 0
        for m in self.specials.finditer(text):
            parts += [self._plain(text[at : m.start()]), f"S{chr(0xF0000 + self.special[m.group()])}"]
            at = m.end()
        return " ".join([*parts, self._plain(text[at:])])

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, and n + 1 offsets into them."""
        plain = [self.normalise(t) for t in texts]
        joined = "\n".join(plain)
        raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        firsts = np.cumsum([0, *(len(t) + 1 for t in plain)])
        starts, ends = cut_words(points, self.kinds)
        # A special token's mark is cut into its letter and its character; the letter alone says which word it is.
        marked = points[starts] == ord("S")
        special = points[np.minimum(starts[marked] + 1, len(points) - 1)].astype(np.int64) - 0xF0000
        keep = np.ones(len(starts), bool)
        keep[np.flatnonzero(marked) + 1] = False
        keep[marked] = False
        of_text = np.searchsorted(starts[keep], firsts)
        if len(raw) == len(points):
            low, high = starts[keep], ends[keep]
        else:
            place = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            low, high = place[starts[keep]], place[ends[keep]]
        # Words and the gaps between them, of which only the words are taken.
        bounds = np.empty(2 * len(low) + 1, np.int64)
        bounds[:-1:2], bounds[1::2], bounds[-1] = low, high, len(raw)
        whole = pa.LargeStringArray.from_buffers(2 * len(low), pa.py_buffer(bounds), pa.py_buffer(raw.tobytes()))
        words = whole.take(pa.array(np.arange(0, 2 * len(low), 2))).dictionary_encode()
        _, offsets, data = words.dictionary.buffers()
        offsets = np.frombuffer(offsets, np.int64)[: len(words.dictionary) + 1]
        symbols = np.frombuffer(data, np.uint8)[: offsets[-1]].astype(np.int64) if data is not None and data.size else np.zeros(0, np.int64)
        if self.end:
            symbols[offsets[1:][np.diff(offsets) > 0] - 1] += 256
        found, at = self.automaton.words(symbols, offsets)
        lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(found, pa.int32())).take(words.indices)
        ids, per_word = lists.values.to_numpy(), lists.offsets.to_numpy()
        if marked.any():
            # Put in behind the words that come before each.
            before = np.cumsum(keep)[marked]
            ids = np.insert(ids, per_word[before], special)
            ahead = np.searchsorted(starts[marked], firsts)
            return ids.astype(np.int32), per_word[of_text] + ahead
        return ids, per_word[of_text]

    def texts_of(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decoding: the labels of arcs in order, parted by spaces, as bytes and n + 1 offsets; each text ends in a space."""
        _, offsets, data = self.labels.take(pa.array(ids, pa.int32())).buffers()
        offsets = np.frombuffer(offsets, np.int64)
        return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets[at]

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit numbers, and the text that decoding them gives, in UTF-8."""
        ids, at = self.tokens([text])
        labels, to = self.texts_of(ids, at)
        return ids.astype("<i4").tobytes(), labels[: max(0, to[-1] - 1)].tobytes()


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode(documents: DataFrame, path: str, with_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids also the array ids.

    `path` names the vocabulary file. Whole texts are encoded, special tokens in a text included as the file says, none
    added. Defined cases: a null or empty text, or one of white space, has no tokens and both digests are those of empty
    input; repeated rows and null ids are encoded like others; an empty table gives no rows; other columns are ignored,
    but for those named in carry, which come last. The file must be at the same path on every executor, as an installed package is; it is not copied."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)

        def digest(data: np.ndarray, at: np.ndarray, less: int) -> pa.Array:
            return pa.array([hashlib.sha256(data[i : max(i, j - less)]).hexdigest() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())

        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = bpe.tokens([t or "" for t in batch.column("text").to_pylist()])
                labels, to = bpe.texts_of(ids, at)
                # The space behind a text's last label belongs to nothing.
                columns = [batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), digest(ids.astype("<i4").view(np.uint8), 4 * at, 0), digest(labels, to, 1)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)]
                yield pa.RecordBatch.from_arrays([*columns, *map(batch.column, carry)], names=[*names, *carry])

    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *carry)
    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.mapInArrow(kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + kept)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"), word_vocabulary())
