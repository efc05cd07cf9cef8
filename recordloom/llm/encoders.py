"""Word-wise use of a tokenizer whose tokens never cross white space."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from recordloom.llm.common import kept, listed, tokenizer_path

#: What may trail a word: one run of it behind an ASCII letter is always a token group of its own.
TRAIL = b".,;:!?*$%&#"
_LETTERS = frozenset(range(97, 123))


class WordEncoder:
    """Encodes texts with a tokenizers file that drops white space, one distinct word at a time.

    Normaliser and splitter of such a file work within white-space separated words, so the ids of a text are
    those of its words in order. Words split at ASCII white space; a word's ids are kept in a cache bounded by bytes,
    in two generations: when the younger is half of it, the elder goes, but for what has been met again since.
    Lower case is folded first only where no special token could be made by it. New words go to the tokenizer
    together, parted by a separator that none of them holds, or, those of A to Z alone, by the tokens that end a group, if the
    vocabulary marks these; marks that trail a word are looked up apart.
    """

    #: Bytes that a cached word takes besides its own and its ids': two objects and a place in the table.
    COST = 180

    def __init__(self, name: str, cache_bytes: int = 120 << 20, separator: str = "|"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.separator = separator.encode()
        ids = self.tokenizer.encode(separator, add_special_tokens=False).ids
        self.mark = ids[0] if len(ids) == 1 else None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: By id, whether a token ends a group; none where groups have no mark of their own.
        self.last = np.zeros(0, bool)
        if suffix and not any(t.content.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values()):
            vocab = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.cache: dict[bytes, bytes] = {}
        self.elder: dict[bytes, bytes] = {}
        self.size, self.limit = 0, cache_bytes // 2

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[bytes]) -> None:
        """Put words into the cache that aren't there."""
        apart = [w for w in words if self.mark is None or self.separator in w or b"<|" in w]
        for word in apart:
            self.cache[word] = self._ids(word.decode("utf-8")).tobytes()
        plain = words if not apart else [w for w in words if w not in self.cache]
        letters = [w for w in plain if w.isalpha()] if len(self.last) else []
        for at in range(0, len(letters), 20_000):
            # of A to Z alone, so each is one group
            part = letters[at : at + 20_000]
            ids = self._ids(b" ".join(part).decode("utf-8"))
            cuts = np.flatnonzero(self.last[ids])
            if len(cuts) != len(part):
                letters = letters[:at]
                break
            data, first = ids.tobytes(), 0
            for word, cut in zip(part, (4 * cuts + 4).tolist(), strict=True):
                self.cache[word] = data[first:cut]
                first = cut
        if letters:
            plain = [w for w in plain if w not in self.cache]
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            ids = self._ids((b" " + self.separator + b" ").join(part).decode("utf-8"))
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part) - 1:
                raise ValueError("the separator isn't a token of its own")
            data, first = ids.tobytes(), 0
            for word, cut in zip(part, [*(4 * cuts).tolist(), len(data)], strict=True):
                self.cache[word] = data[first:cut]
                first = cut + 4
        self._grown(words)

    def _grown(self, words: list[bytes]) -> None:
        self.size += sum(map(len, words)) + sum(map(len, map(self.cache.__getitem__, words))) + self.COST * len(words)

    def _met_again(self, words: set[bytes]) -> set[bytes]:
        """Take over what the elder generation has; returns the rest."""
        known = [w for w in words if w in self.elder]
        for w in known:
            self.cache[w] = self.elder[w]
        self._grown(known)
        return words.difference(known)

    def _missing(self, words: set[bytes]) -> None:
        cache, halves, need = self.cache, [], set()
        for word in words:
            core = word.rstrip(TRAIL)
            if len(core) < len(word) and core and core[-1] in _LETTERS and b"<|" not in word:
                halves.append((word, core, word[len(core) :]))
                need.update(halves[-1][1:])
            else:
                need.add(word)
        self._learn(list(self._met_again(need.difference(cache))))
        for word, core, trail in halves:
            cache[word] = cache[core] + cache[trail]
        self._grown([word for word, _, _ in halves])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        low = [t if b"<|" in x else x for t, x in ((t, t.lower()) for t in texts)]
        lists = pc.ascii_split_whitespace(pa.array(low, pa.large_binary()).view(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        words = listed(coded.dictionary.view(pa.large_binary()))  # white space at an end of a text makes an empty one
        cache = self.cache
        new = {w for w in words if w and w not in cache}
        if new and self.size > self.limit:
            self.elder, self.cache, self.size = cache, {}, 0
            cache, new = self.cache, {w for w in words if w}
        if new:
            self._missing(self._met_again(new))
        ids = pa.array([cache[w] if w else b"" for w in words], pa.large_binary()).take(coded.indices)
        return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, ids), pa.scalar(b"", pa.large_binary())).to_pylist()


def shared_encoder(name: str) -> WordEncoder:
    """The worker's encoder, kept with its cache from task to task until another operator's task comes."""
    return kept(f"words:{name}", lambda: WordEncoder(name))
