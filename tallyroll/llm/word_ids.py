"""Token ids of texts by a tokenizer that cuts text into words before its model sees it.

``encode`` gives exactly what the library gives for whole texts.  Where the tokenizer's own
settings say how text is cut, most of the work is done on arrays:

* Its normaliser composes characters, turns white space into spaces and lower-cases; its splitter
  takes contractions, runs of letters, single numbers and runs of other characters, and drops
  white space.  None of this reaches across white space, so words between white space may be
  encoded apart.
* Latin-1 characters never compose with each other and lower-case one to one, so in words of
  these alone, without an apostrophe (no contraction) and without the start of an added token,
  units begin where the kind of character changes and at every number.
* Units of up to 16 characters are looked up in a table of those met before, compared whole;
  only new ones go to the tokenizer, many at a time.  All other words go to it as they are.

Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import functools
import json

import numpy as np

NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Units remembered, and places of their table.
MEMO_UNITS = 300_000
SLOTS = 1 << 19
#: Texts are encoded in parts of about so many characters.
PART_CHARS = 1_000_000
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def _kinds() -> np.ndarray:
    """The kind of each Latin-1 character."""
    out = np.full(256, OTHER, np.uint8)
    for c in range(256):
        if chr(c).isalpha():
            out[c] = LETTER
        elif chr(c).isnumeric():
            out[c] = NUMBER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = SPACE
    return out


KIND = _kinds()
LOWER = np.array([ord(chr(c).lower()) for c in range(256)], np.uint8)


def _by_words(tok) -> bool:
    """Whether the tokenizer cuts text as the module says, whatever its vocabulary."""
    told = json.loads(tok.to_str())
    split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    cut = told.get("normalizer") == {"type": "Sequence", "normalizers": NORMALIZER} and told.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [split, level]}
    plain = all(x["content"].startswith("<|") and not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in told.get("added_tokens", []))
    return bool(cut and plain and not told["model"].get("dropout"))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.by_words = _by_words(self.tok)
        told = self.tok.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(told.values(), default=0) + 1, bool)  # pieces that end a unit
        self.last[[i for piece, i in told.items() if piece.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.low, self.high = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.at = np.full(SLOTS, -1, np.int32)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each remembered unit, in the pool
        self.pool = np.zeros(0, np.uint32)
        self.words: dict[str, np.ndarray] = {}

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, units: list[str]) -> list[np.ndarray]:
        """The ids of each unit: many go as one text with spaces between, and are told apart by the pieces that end a unit."""
        out: list[np.ndarray] = []
        for k in range(0, len(units), 2_000):
            part = units[k : k + 2_000]
            ids = self.library([" ".join(part)])[0]
            ends = np.flatnonzero(self.last[np.minimum(ids, len(self.last) - 1)]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                cut = ends.tolist()
                out += [ids[a:b] for a, b in zip([0, *cut], cut)]
            else:
                out += self.library(part)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        part: list[str] = []
        size = 0
        for i, text in enumerate(texts):
            part.append(text)
            size += len(text)
            if size >= PART_CHARS or i == len(texts) - 1:
                out += self._part(part) if self.by_words else self.library(part)
                part, size = [], 0
        return out

    def _part(self, texts: list[str]) -> list[np.ndarray]:
        raw, strange = [], []
        for i, text in enumerate(texts):
            try:
                raw.append(text.encode("latin-1"))
            except UnicodeEncodeError:
                points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
                wide = points > 255
                strange.append((i, wide))
                raw.append(np.where(wide, ord("x"), points).astype(np.uint8).tobytes())
        begin = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in raw], out=begin[1:])
        data = LOWER[np.frombuffer(b" ".join((*raw, bytes(16))), np.uint8)]  # 16 more bytes, so that keys can be read
        chars = data[: begin[-1]]
        kind = KIND[chars]
        odd = (chars == ord("'")) | (chars == 0)
        odd[:-1] |= (chars[:-1] == ord("<")) & (chars[1:] == ord("|"))
        for i, wide in strange:
            odd[begin[i] : begin[i] + len(wide)] |= wide

        new = np.empty(len(kind), bool)
        new[:1] = True
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(kind)))
        filled = kind[start] != SPACE
        if odd.any():
            # Words with an odd character are one unit each: what begins inside them is no unit.
            blank = kind == SPACE
            word_at = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
            word_end = np.append(np.flatnonzero(blank[1:] & ~blank[:-1]) + 1, [] if blank[-1:].all() else len(blank)).astype(np.int64)
            bad = np.unique(np.searchsorted(word_at, np.flatnonzero(odd & ~blank), side="right") - 1)
            depth = np.zeros(len(kind) + 1, np.int8)
            depth[word_at[bad]] += 1
            depth[word_end[bad]] -= 1
            inside = np.cumsum(depth[:-1], dtype=np.int8) > 0
            filled &= ~inside[start]
            start = np.concatenate((start[filled], word_at[bad]))
            size = np.concatenate((size[filled], (word_end - word_at)[bad]))
            whole = np.zeros(len(start), bool)
            whole[len(start) - len(bad) :] = True
            order = np.argsort(start, kind="stable")
            start, size, whole = start[order], size[order], whole[order]
        else:
            start, size = start[filled], size[filled]
            whole = np.zeros(len(start), bool)
        return self._ids(texts, data, begin, start, size, whole | (size > 16))

    def _ids(self, texts: list[str], data: np.ndarray, begin: np.ndarray, start: np.ndarray, size: np.ndarray, whole: np.ndarray) -> list[np.ndarray]:
        held = len(self.count)
        unit = np.empty(len(start), np.int64)
        extra: list[np.ndarray] = []
        # Words that go to the tokenizer as they are.
        if whole.any():
            where = np.flatnonzero(whole)
            owner = np.searchsorted(begin, start[where], side="right") - 1
            lo = (start[where] - begin[owner]).tolist()
            words = [texts[o][a : a + n] for o, a, n in zip(owner.tolist(), lo, size[where].tolist())]
            missing = [w for w in dict.fromkeys(words) if w not in self.words]
            fresh = dict(zip(missing, self.library(missing))) if missing else {}
            number = {w: k for k, w in enumerate(dict.fromkeys(words))}
            extra = [self.words[w] if w in self.words else fresh[w] for w in number]
            unit[where] = held + np.fromiter((number[w] for w in words), np.int64, len(words))
            if len(self.words) < MEMO_UNITS // 4:
                self.words.update((w, ids) for w, ids in fresh.items() if len(w) <= 64)
        # Short units, by table.
        short = np.flatnonzero(~whole)
        view = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
        at, n = start[short], size[short]
        keep = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1] * 9, np.uint64)
        low = view[at] & keep[n]
        high = view[at + 8] & np.where(n > 8, keep[np.maximum(n - 8, 0)], np.uint64(0))
        mixed = _mix(low, high)
        found = np.full(len(short), -1, np.int64)
        for shift in (45, 20):
            open_ = np.flatnonzero(found < 0)
            slot = (mixed[open_] >> np.uint64(shift)).astype(np.int64) & (SLOTS - 1)
            same = (self.low[slot] == low[open_]) & (self.high[slot] == high[open_])
            found[open_[same]] = self.at[slot[same]]
        lost = np.flatnonzero(found < 0)
        if len(lost):
            order = lost[np.lexsort((high[lost], low[lost]))]
            first = np.concatenate(([True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])))
            one = order[first]
            raw = data.tobytes()
            ids = self.units([raw[a : a + k].decode("latin-1") for a, k in zip(at[one].tolist(), n[one].tolist())])
            found[order] = held + len(extra) + np.cumsum(first) - 1
            extra += ids
        unit[short] = found

        lengths = np.concatenate((self.count, [len(x) for x in extra])).astype(np.int64)
        pool = np.concatenate((self.pool, *extra)) if extra else self.pool
        firsts = np.concatenate((self.first, len(self.pool) + np.cumsum(lengths[held:]) - lengths[held:])).astype(np.int64)
        times = lengths[unit]
        ends = np.cumsum(times)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.repeat(firsts[unit] - (ends - times), times) + np.arange(total)]
        cut = np.append(0, ends)[np.searchsorted(start, begin)].tolist()
        if len(lost):
            self._remember(low[one], high[one], mixed[one], extra[len(extra) - len(one) :])
        return [ids[a:b] for a, b in zip(cut, cut[1:])]

    def _remember(self, low, high, mixed, ids) -> None:
        if len(self.count) + len(ids) > MEMO_UNITS:
            if len(self.count) >= MEMO_UNITS // 2:
                return
            room = MEMO_UNITS - len(self.count)
            low, high, mixed, ids = low[:room], high[:room], mixed[:room], ids[:room]
        number = len(self.count) + np.arange(len(ids), dtype=np.int32)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.first = np.concatenate((self.first, len(self.pool) + np.cumsum(lengths) - lengths))
        self.count = np.concatenate((self.count, lengths))
        self.pool = np.concatenate((self.pool, *ids))
        left = np.arange(len(ids))
        for shift in (45, 20):
            slot = (mixed[left] >> np.uint64(shift)).astype(np.int64) & (SLOTS - 1)
            free = self.at[slot] < 0
            left_, slot = left[free], slot[free]
            slot, pick = np.unique(slot, return_index=True)
            mine = left_[pick]
            self.low[slot], self.high[slot], self.at[slot] = low[mine], high[mine], number[mine]
            left = np.setdiff1d(left, mine, assume_unique=True)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
