"""Token ids of whole Arrow batches."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of any kind; a single space between other characters is where a byte-level vocabulary starts a word.
_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
#: Words that are encoded as one text.
RUN = 256
_JOINED = f" {_SPACE}|{_SPACE} |^ | $"


class Encoder:
    """Ids of texts, with every distinct word encoded once while at most `keep` of them are remembered.

    A byte-level vocabulary never joins characters across the start of a space that stands alone, so the ids of a text
    are the ids of its parts at such spaces, one after the other. A text with other white space beside a space is
    encoded as a whole.
    """

    def __init__(self, path: str, keep: int = 1 << 19):
        import os

        from tokenizers import Tokenizer

        # Spark runs a task per core already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.spaced[number] = token.startswith("\u0120")
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.sizes = pa.array([], pa.large_string()), np.empty(0, np.uint32), np.empty(0, np.int64)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Rows of words that follow a space in the table of known ones.

        Many new ones are encoded as one text: no other id begins with a space, so those that do tell where a word begins.
        """
        if len(self.known) + len(words) > self.keep:
            self._forget()
        rows = pc.index_in(words, value_set=self.known)
        if not rows.null_count:
            return rows.to_numpy()
        words = words.filter(rows.is_null())
        texts = [" " + " ".join(words.slice(at, RUN).to_pylist()) for at in range(0, len(words), RUN)]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(found)
        self.sizes = np.concatenate([self.sizes, np.diff(np.append(np.flatnonzero(self.spaced[flat]), len(flat)))])
        self.flat = np.concatenate([self.flat, flat])
        rows = rows.to_numpy(zero_copy_only=False)
        fresh = np.isnan(rows)
        rows[fresh] = len(self.known) + np.arange(len(words))
        self.known = pa.concat_arrays([self.known, words])
        return rows.astype(np.int64)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and their number for each text; a null text has none."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = np.asarray(pc.match_substring_regex(texts, _JOINED).cast(pa.int8())).astype(bool)
        parts = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        heads = np.cumsum(np.asarray(pc.list_value_length(parts)).astype(np.int64))
        heads = np.concatenate([[0], heads[:-1]])
        coded = parts.flatten().dictionary_encode()
        place = np.asarray(coded.indices).astype(np.int64)
        # The first part of a text has no space before it and gets ids of its own, behind those of the words.
        first = coded.dictionary.take(pa.array(place[heads]))
        place[heads] = len(coded.dictionary) + np.arange(len(heads))
        used = np.zeros(len(coded.dictionary) + len(heads), bool)
        used[place] = True
        rows = np.zeros(len(used), np.int64)
        rows[np.flatnonzero(used[:len(coded.dictionary)])] = self._learn(coded.dictionary.filter(pa.array(used[:len(coded.dictionary)])))
        more, tops = self._each(first.to_pylist())
        rows[len(coded.dictionary):] = len(self.known) + np.arange(len(heads))
        place = rows[place]
        table, sizes = np.concatenate([self.flat, more]), np.concatenate([self.sizes, tops])
        begin = np.cumsum(sizes) - sizes
        size = sizes[place]
        ends = np.cumsum(size)
        out = table[np.repeat(begin[place] - ends + size, size) + np.arange(ends[-1])]
        lengths = np.add.reduceat(size, heads)
        if whole.any():
            cuts, pieces = np.concatenate([[0], np.cumsum(lengths)]), []
            for i in range(len(texts)):
                if whole[i]:
                    ids, n = self._each([texts[i].as_py()])
                    lengths[i] = n[0]
                else:
                    ids = out[cuts[i]:cuts[i + 1]]
                pieces.append(ids)
            out = np.concatenate(pieces)
        return out, lengths


class Words:
    """Ids of texts by a vocabulary that drops white space and lowers case, with every distinct word encoded once.

    Such a vocabulary never joins characters across white space, so the ids of a text are those of the runs between ASCII
    white space, one after the other. Sentence marks at the end of a run, behind a letter or digit, are a run of their own, and
    A-Z are lowered beforehand, so that fewer runs are distinct. At most `keep` of them are remembered.
    """

    MARK = "\x01"

    def __init__(self, path: str, keep: int = 3 << 18):
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size, self.keep = self.tokenizer.get_vocab_size(), keep
        made = self.tokenizer.encode(self.MARK, add_special_tokens=False)
        self.mark = made.ids if len(made.ids) == 1 else None
        # Runs of a-z alone need no normal form and no splitting, which cost as much as the vocabulary itself. There the mark
        # is written as the vocabulary has it.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.plain_mark = made.tokens[0].removesuffix(self.plain.model.end_of_word_suffix or "") if self.mark else None
        test = [self.plain_mark or "", "abcdefghijklmnopqrstuvwxyz", "the"]
        same = [self.tokenizer.encode(w if w != test[0] else self.MARK, add_special_tokens=False).ids == self.plain.encode(w, add_special_tokens=False).ids for w in test]
        self.plainly = bool(self.mark) and all(same)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int32)

    def _encoded(self, words: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order and their number for each. Many go as one text, each behind a mark that is a token of its own."""
        if not words:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        tokenizer, mark = (self.plain, self.plain_mark) if plain else (self.tokenizer, self.MARK)
        if self.mark is None or not plain and any(mark in w for w in words):
            found = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.concatenate([np.empty(0, np.uint32), *(np.array(x, np.uint32) for x in found)]), np.array([len(x) for x in found], np.int64)
        head, between = f"{mark} ", f" {mark} "
        made = tokenizer.encode_batch_fast([head + between.join(words[i:i + RUN]) for i in range(0, len(words), RUN)], add_special_tokens=False)
        ids = np.concatenate([np.array(one.ids, np.uint32) for one in made])
        marks = ids == self.mark[0]
        return ids[~marks], np.diff(np.append(np.flatnonzero(marks), len(ids))) - 1

    def _rows(self, words: list[str]) -> np.ndarray:
        """Rows of words in the table of known ones, which learns those that are new."""
        known = self.known
        rows = list(map(known.get, words, repeat(-1)))
        if min(rows, default=0) < 0:
            fresh = list(dict.fromkeys(w for w, r in zip(words, rows) if r < 0))
            if len(known) + len(fresh) > self.keep and known:
                self._forget()
                return self._rows(words)
            plain = [w for w in fresh if w.isascii() and w.isalpha() and w.islower()] if self.plainly else []
            fresh = plain + [w for w in fresh if not (w.isascii() and w.isalpha() and w.islower())] if plain else fresh
            flat, sizes = (np.concatenate(x) for x in zip(self._encoded(plain, True), self._encoded(fresh[len(plain):], False)))
            ends = len(self.flat) + np.cumsum(sizes)
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            self.flat = np.concatenate([self.flat, flat])
            self.begin, self.sizes = np.concatenate([self.begin, ends - sizes]), np.concatenate([self.sizes, sizes.astype(np.int32)])
            rows = list(map(known.__getitem__, words))
        return np.array(rows, np.int64)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and their number for each text; a null text has none."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        counts = np.asarray(pc.list_value_length(parts)).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        runs = coded.dictionary
        stem = pc.utf8_rtrim(runs, characters=".,;:!?")
        apart = pc.match_substring_regex(stem, r"[\p{L}\p{N}]$")
        low = pc.ascii_lower(pc.if_else(apart, stem, runs))
        longer = np.flatnonzero(np.asarray(pc.binary_length(low)) < np.asarray(pc.binary_length(runs)))
        # What was cut off is ASCII, so its length in bytes is that in characters.
        cut = runs.take(pa.array(longer)).to_pylist()
        tails = [run[len(word):] for run, word in zip(cut, low.take(pa.array(longer)).to_pylist())]
        rows = self._rows([*low.to_pylist(), *tails, ""])
        head, tail = rows[:len(runs)], np.full(len(runs), rows[-1])
        tail[longer] = rows[len(runs):-1]
        # Ids of each distinct run: those of its stem and those of its tail.
        both = np.stack([head, tail], 1).reshape(-1)[np.stack([coded.indices.to_numpy() * 2, coded.indices.to_numpy() * 2 + 1], 1).reshape(-1)]
        size = self.sizes[both].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = self.flat[np.repeat(self.begin[both] - ends + size, size) + np.arange(total)]
        upto = np.concatenate([[0], ends[1::2]])[np.concatenate([[0], np.cumsum(counts)])]
        return out, np.diff(upto)


_shared: dict[tuple[type, str], Encoder | Words] = {}


def shared(kind: type, path: str):
    """One encoder for all tasks of a worker, so that words that one task has met are known to the next."""
    if (kind, path) not in _shared:
        _shared.clear()
        _shared[kind, path] = kind(path)
    return _shared[kind, path]
