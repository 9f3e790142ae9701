"""Byte-pair encoding over batches: rank-synchronous array merging, and a library encoder that meets each distinct word of a batch once."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

NO_RANK = np.iinfo(np.int32).max
NO_IDS = np.empty(0, "<u4")
#: The split pattern of the byte-level vocabulary; \s is Unicode white space, spelled out.
SPACE_CLASS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BYTE_LEVEL = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE_CLASS}\p{{L}}\p{{N}}]+|[{SPACE_CLASS}]+(?![^{SPACE_CLASS}])|[{SPACE_CLASS}]+"
)
#: Characters below this one are classed alike by every Unicode version in use.
PLAIN_LIMIT = "\u0300"
#: How the vocabularies write a space and the end of a word.
SPACE, WORD_END = "Ġ", "</w>"
#: Words that a vocabulary takes as a run of letters, with a run of marks after it or none. Nothing in them composes, and each letter has one lower case.
LETTERS_AND_MARKS = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
#: How the vocabularies fold a text and split it; words of another one are not taken apart.
BYTE_RULES = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of every byte: printable Latin-1 stands for itself, the rest is moved above 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class RankTable:
    """Merge ranks of a byte-level vocabulary as sorted arrays."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        model = parsed["model"]
        vocab = model["vocab"]
        self.specials = [t["content"] for t in parsed.get("added_tokens", [])]
        self.first = np.zeros(256, np.int64)
        for char, byte in byte_alphabet().items():
            self.first[byte] = vocab[char]
        left, right, new = [], [], []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left.append(vocab[a])
            right.append(vocab[b])
            new.append(vocab[a + b])
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int32)
        self.new = np.array(new, np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of every word."""
        flat, owner = self._merge(words)
        ends = np.searchsorted(owner, np.arange(len(words)), side="right")
        return np.split(flat, ends[:-1]) if words else []

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of every word."""
        return np.bincount(self._merge(words)[1], minlength=len(words)).astype(np.int64)

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        ranks = np.full(len(symbols), NO_RANK, np.int32)  # of the pair that begins here
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inside] = self.pair_ranks(symbols[inside], symbols[inside + 1])
        while len(symbols) > 1:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
            over = lowest == NO_RANK
            if over.any():  # words without a pair to merge leave the arrays
                done.append((symbols[over], owner[over]))
                symbols, owner, ranks, lowest = (x[~over] for x in (symbols, owner, ranks, lowest))
                if not len(symbols):
                    break
            hit = ranks == lowest
            # of pairs that overlap, as in "aaa", every second one counts, from the left
            before = np.r_[False, hit[:-1]]
            if (hit & before).any():
                index = np.arange(len(hit))
                run_start = np.maximum.accumulate(np.where(hit & ~before, index, -1))
                hit &= (index - run_start) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = self.new[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # where they are now
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            # only the pairs on both sides of a new symbol have another rank
            ranks[at] = NO_RANK
            changed = np.unique(np.r_[at, at[at > 0] - 1])
            changed = changed[changed < len(symbols) - 1]
            changed = changed[owner[changed] == owner[changed + 1]]
            ranks[changed] = self.pair_ranks(symbols[changed], symbols[changed + 1])
        done.append((symbols, owner))
        flat = np.concatenate([x for x, _ in done])
        owners = np.concatenate([x for _, x in done])
        order = np.argsort(owners, kind="stable")
        return flat[order], owners[order]


@dataclass
class Words:
    """Texts as runs of words between single spaces: ``codes`` of text i are those from ``starts[i]`` to ``starts[i + 1]``.

    A text where some space has white space before it is not cut (``whole``): there a token may reach across. The first word of a
    text stands without a space before it.
    """

    distinct: pa.Array
    codes: np.ndarray
    starts: np.ndarray
    whole: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        distinct, codes, starts = coded_words(texts)
        odd = odd_ends(distinct)[codes] if len(codes) else np.empty(0, bool)
        if len(starts) > 1:
            odd[starts[1:] - 1] = False  # nothing follows a text's last word
        whole = np.add.reduceat(odd, starts[:-1]) > 0 if len(codes) else np.zeros(len(texts), bool)
        return cls(distinct, codes, starts, whole)


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words between single spaces, the code of every word, and where each text's codes begin."""
    parts = pc.split_pattern(texts, " ")
    coded = parts.flatten().dictionary_encode()
    starts = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(parts)), dtype=np.int64)]
    return coded.dictionary, np.asarray(coded.indices), starts


def laid_out(flat: np.ndarray, places: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Ids of words in a row: those of code c begin at ``places[c]`` of ``flat`` and are ``lengths[c]`` many."""
    n = lengths[codes]
    ends = np.cumsum(n)
    return flat[np.repeat(places[codes] - ends + n, n) + np.arange(ends[-1])] if len(ends) and ends[-1] else NO_IDS


def odd_ends(words: pa.Array) -> np.ndarray:
    """Whether a word is empty or ends in white space (Unicode's, and the separators 1C to 1F)."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    size = np.diff(ends)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    last = np.zeros(len(words), np.uint8)
    last[size > 0] = data[ends[1:][size > 0] - 1]
    odd = (size == 0) | ((last >= 9) & (last <= 13)) | ((last >= 28) & (last <= 32))
    beyond = np.flatnonzero(last >= 128)
    odd[beyond] = [words[i].as_py()[-1].isspace() for i in beyond]
    return odd


class CountingWords:
    """Token counts of texts: a text's words between single spaces are split and merged once a batch, by arrays."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.table = RankTable(spec)
        self.pattern = regex.compile(BYTE_LEVEL)
        self.special = re.compile("|".join(map(re.escape, sorted(self.table.specials, key=len, reverse=True))) or r"(?!)")
        self.library = Tokenizer.from_str(spec).pre_tokenizer
        self.bytes_of = {c: b for c, b in byte_alphabet().items()}

    def pretokens(self, text: str) -> list[bytes]:
        if text.isascii() or max(text) < PLAIN_LIMIT:
            return [w.encode() for w in self.pattern.findall(text)]
        split = self.library.pre_tokenize_str(text)
        return [bytes(self.bytes_of[c] for c in w) for w, _ in split]

    def counts(self, pieces: list[str]) -> np.ndarray:
        """Tokens of every piece: split by specials, then by the pattern, then merged; a pretoken that pieces share merges once."""
        found = np.zeros(len(pieces), np.int64)
        merged: dict[bytes, int] = {}
        at, whose = [], []
        for i, piece in enumerate(pieces):
            parts = self.special.split(piece) if self.special.search(piece) else (piece,)
            found[i] = len(parts) - 1
            for part in parts:
                own = [merged.setdefault(w, len(merged)) for w in self.pretokens(part)] if part else ()
                at += own
                whose += [i] * len(own)
        if at:
            found += np.bincount(np.array(whose), self.table.counts(list(merged))[np.array(at)], len(pieces)).astype(np.int64)
        return found

    def batch(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.empty(0, np.int64)
        words = Words.of(texts)
        first = words.starts[:-1]
        rest = ~np.repeat(words.whole, np.diff(words.starts))
        rest[first] = False
        used = np.unique(words.codes[rest])
        spelled = [f" {w}" for w in words.distinct.take(pa.array(used)).to_pylist()]
        heads = [texts[i].as_py() if w else words.distinct[words.codes[k]].as_py() for i, (w, k) in enumerate(zip(words.whole, first, strict=True))]
        counted = self.counts(spelled + heads)
        of_word = np.zeros(len(words.distinct), np.int64)
        of_word[used] = counted[: len(used)]
        return np.add.reduceat(np.where(rest, of_word[words.codes], 0), first) + counted[len(used) :]


class LibraryWords:
    """Ids of texts by the tokenizers library, which meets every distinct word of a batch once. Nothing is kept between batches.

    ``spaced``: a space belongs to the word after it (byte-level); else spaces vanish (word vocabularies). The words' ids joined are
    the text's ids: no token and no rule of either kind reaches across such a space. Words go to the library many in a string, and
    their ids are told apart by the tokens that begin with a space, or by those that end a word. A vocabulary with ``BYTE_RULES`` or
    ``WORD_RULES`` meets plain letters once, whatever marks follow them. A word vocabulary meets them in lower case, so its normalizer,
    which would change nothing, is left out for them.
    """

    def __init__(self, spec: str, spaced: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = self.plain = Tokenizer.from_str(spec)
        self.spaced = spaced
        parsed = json.loads(spec)
        self.cuts = all(parsed[k] == rules for k, rules in (BYTE_RULES if spaced else WORD_RULES).items())
        if self.cuts and not spaced:
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = self.tokenizer.pre_tokenizer
        vocab = self.tokenizer.get_vocab()
        edge = (lambda t: t[0] == SPACE) if spaced else (lambda t: t.endswith(WORD_END))
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for t, i in vocab.items() if t and edge(t)]] = True

    def encode(self, texts: list[str], plain: bool = False) -> list[np.ndarray]:
        found: list[np.ndarray] = []
        tokenizer = self.plain if plain else self.tokenizer
        for i in range(0, len(texts), 1000):
            found += [np.array(x.ids, "<u4") for x in tokenizer.encode_batch_fast(texts[i : i + 1000], add_special_tokens=False)]
        return found

    def joined(self, words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of words that each have one token at an edge, 256 words to a string, and how many ids each word has."""
        for low in range(0, len(words), 256 * 32):
            own = words.slice(low, 256 * 32)
            cuts = [*range(0, len(own), 256), len(own)]
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), own)
            coded = self.encode([f" {part}" for part in pc.binary_join(lists, " ").to_pylist()], plain=True)
            for start, end, ids in zip(cuts[:-1], cuts[1:], coded, strict=True):
                at = np.flatnonzero(self.edge[ids])
                if len(at) != end - start:  # a word isn't what it seemed
                    yield self.apart(own.slice(start, end - start))
                elif self.spaced:
                    yield ids, np.diff(np.r_[at, len(ids)])
                else:
                    yield ids, np.diff(np.r_[-1, at])

    def apart(self, words: pa.Array, lead: str = " ") -> tuple[np.ndarray, np.ndarray]:
        found = self.encode([f"{lead}{w}" for w in words.to_pylist()])
        return np.concatenate([*found, NO_IDS]), np.fromiter(map(len, found), np.int64, len(found))

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, each with a space before it: all ids, and where each word's begin and how many they are.

        A word is letters and the marks after them, each distinct one encoded once, or is encoded as it is.
        """
        cut = pc.extract_regex(words, LETTERS_AND_MARKS)
        simple = np.asarray(cut.is_valid()) & self.cuts
        cut, others = cut.filter(pa.array(simple)), np.flatnonzero(~simple)
        letters, marks = cut.field(0), cut.field(1).dictionary_encode()
        letters = (letters if self.spaced else pc.utf8_lower(letters)).dictionary_encode()
        easy = np.fromiter((self.spaced and w != "" and not w[0].isspace() and not w[-1].isspace() for w in words.take(pa.array(others)).to_pylist()), bool, len(others))
        easy, hard = others[easy], others[~easy]
        found = [
            *self.joined(letters.dictionary), self.apart(marks.dictionary, lead=""),
            *self.joined(words.take(pa.array(easy))), self.apart(words.take(pa.array(hard))),
        ]
        flat, lengths = np.concatenate([ids for ids, _ in found]), np.concatenate([*(n for _, n in found), [0]])
        both = np.full((len(words), 2), len(lengths) - 1)  # codes of a word's parts; the last code is that of no part
        both[simple, 0] = np.asarray(letters.indices)
        both[simple, 1] = np.asarray(marks.indices) + len(letters.dictionary)
        both[np.r_[easy, hard], 0] = np.arange(len(others)) + len(letters.dictionary) + len(marks.dictionary)
        of_word = lengths[both].sum(axis=1)
        return laid_out(flat, np.cumsum(lengths) - lengths, lengths, both.ravel()), np.cumsum(of_word) - of_word, of_word

    def batch(self, texts: pa.Array, at_once: int = 1 << 20) -> Iterator[np.ndarray]:
        """Little-endian 32-bit ids of every text, in order; about ``at_once`` ids are laid out at a time."""
        if not len(texts):
            return
        if self.spaced:
            words = Words.of(texts)
            distinct, codes, starts = words.distinct, words.codes, words.starts
            rest = ~np.repeat(words.whole, np.diff(starts))
            rest[starts[:-1]] = False
            used = np.unique(codes[rest])
            flat, places, lengths = self.of_words(distinct.take(pa.array(used)))
            at = np.full(len(distinct) + 1, len(used))  # from codes to places of used words; the last is no word
            at[used] = np.arange(len(used))
            kept, places, lengths = at[np.where(rest, codes, len(distinct))], np.r_[places, 0], np.r_[lengths, 0]
        else:
            distinct, kept, starts = coded_words(pc.replace_substring(texts, "\n", " "))
            flat, places, lengths = self.of_words(distinct)
        first = starts[:-1]
        of_text = np.r_[0, np.cumsum(np.add.reduceat(lengths[kept], first))]
        low = 0
        while low < len(first):
            high = max(low + 1, int(np.searchsorted(of_text, of_text[low] + at_once, side="right")) - 1)
            ids = laid_out(flat, places, lengths, kept[starts[low] : starts[high]])
            heads = [NO_IDS] * (high - low)
            if self.spaced:
                heads = self.encode([texts[i].as_py() if words.whole[i] else distinct[codes[first[i]]].as_py() for i in range(low, high)])
            for i, head in enumerate(heads, low):
                own = ids[of_text[i] - of_text[low] : of_text[i + 1] - of_text[low]]
                yield np.concatenate([head, own]) if len(head) else own
            low = high


def frugal(run):
    """A task's function that gives back to the system what it freed when it ends: workers outlive tasks, and what they hold adds up over stages."""

    def task(batches):
        import ctypes
        import gc

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return task


def slices(batch: pa.RecordBatch, text: str, at_most: int = 32 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch of about ``at_most`` bytes of text (a longer one is a part of its own), and their texts (null: empty)."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
    total = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
    low = 0
    while low < batch.num_rows:
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + at_most, side="right")))
        yield batch.slice(low, high - low), texts.slice(low, high - low)
        low = high
