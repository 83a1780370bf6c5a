"""Token ids of texts by a tokenizer file, each distinct run between spaces encoded once.

Ids of runs that were met are kept in flat arrays of some 45 bytes a run, so a Python worker that Spark keeps for other tasks holds little. A run is
found by the hash of its text and its text is compared, so equal hashes do no harm.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT_RUNS = 600_000
#: fixed values: the steps of a tokenizer file under which a text's ids are those of its runs between spaces, lower-cased, one after the other
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"


def goes_by_runs(spec: dict) -> bool:
    """Whether a tokenizer file lower-cases, never crosses white space and marks word ends, so that its ids can be put together from runs."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    splits = steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    plain = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    whole = not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
    return bool(spec.get("normalizer") == NORMALIZER and splits and plain and spec["model"].get("end_of_word_suffix") == WORD_END and whole)


class KnownRuns:
    """Ids by run: sorted hashes with the number of each entry, and by number the runs and their ids, one after the other."""

    def __init__(self) -> None:
        self.keys, self.entry = np.empty(0, np.int64), np.empty(0, np.int32)
        self.runs = pa.array([], pa.string())
        self.begin, self.pool = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, runs: list[str]) -> np.ndarray:
        """The entry of each run, or -1."""
        if not len(self.keys) or not runs:
            return np.full(len(runs), -1, np.int64)
        keys = np.fromiter(map(hash, runs), np.int64, len(runs))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        found = np.full(len(runs), -1, np.int64)
        entry = self.entry[at[hit]]
        same = pc.equal(self.runs.take(pa.array(entry)), pa.array([runs[i] for i in hit.tolist()], pa.string())).to_numpy(zero_copy_only=False)
        found[hit[same]] = entry[same]
        return found

    def ids(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these entries one after the other, how many each has)."""
        sizes = self.begin[entry + 1] - self.begin[entry]
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(self.begin[entry] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], sizes

    def add(self, runs: list[str], ids: list[bytes]) -> None:
        """Adds runs that are not there; of those with one hash the first."""
        if len(self.keys) > KEPT_RUNS:
            self._forget()
        keys, first = np.unique(np.fromiter(map(hash, runs), np.int64, len(runs)), return_index=True)
        at = np.searchsorted(self.keys, keys)
        free = (self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.ones(len(keys), dtype=bool)
        keys, first, at = keys[free], first[free].tolist(), at[free]
        sizes = np.fromiter((len(ids[i]) // 4 for i in first), np.int64, len(first))
        self.entry = np.insert(self.entry, at, np.arange(len(self.runs), len(self.runs) + len(first), dtype=np.int32))
        self.keys = np.insert(self.keys, at, keys)
        self.runs = pa.concat_arrays([self.runs, pa.array([runs[i] for i in first], pa.string())])
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(sizes)))
        self.pool = np.concatenate((self.pool, np.frombuffer(b"".join([ids[i] for i in first]), np.uint32)))

    def _forget(self) -> None:
        """Drops the older half."""
        cut = len(self.runs) // 2
        stay = self.entry >= cut
        self.keys, self.entry = self.keys[stay], self.entry[stay] - np.int32(cut)
        self.runs = pa.concat_arrays([self.runs.slice(cut)])
        self.pool, self.begin = self.pool[self.begin[cut] :].copy(), self.begin[cut:] - self.begin[cut]


class WordTokenizer:
    """Ids of texts by a tokenizer file. Where the file goes by runs, each distinct run between ASCII spaces goes to the library once and is then
    remembered, up to about KEPT_RUNS of them; where it does not, whole texts do.

    Runs of plain letters, lower-cased and without the full stops or commas that follow them, go to the library many in a line, to be
    parted at the tokens that end a word; all others go one by one.
    """

    # below U+0130 lower-casing maps letters one to one
    PLAIN = re.compile("[^\\W\\d_\u0130-\U0010ffff]+")
    LINE = 1000
    _loaded: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_runs = goes_by_runs(json.load(f))
        words = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(words.values(), default=0) + 1, dtype=bool)
        self.word_end[[i for w, i in words.items() if w.endswith(WORD_END)]] = True
        self.known = KnownRuns()

    @classmethod
    def load(cls, path: str) -> WordTokenizer:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _encode(self, lines: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]

    def _ids_of(self, words: list[str]) -> dict[str, bytes]:
        """Ids of lower-case words of plain letters, from what is known or many in a line."""
        ids, new = {}, []
        for w, e in zip(words, self.known.find(words).tolist(), strict=True):
            if e < 0:
                new.append(w)
            else:
                ids[w] = self.known.pool[self.known.begin[e] : self.known.begin[e + 1]].tobytes()
        for lo in range(0, len(new), self.LINE):
            line = new[lo : lo + self.LINE]
            raw = self._encode([" ".join(line)])[0]
            cuts = (4 * (np.flatnonzero(self.word_end[np.frombuffer(raw, dtype="<u4")]) + 1)).tolist()
            if len(cuts) == len(line):
                ids.update((w, raw[a:b]) for w, a, b in zip(line, [0, *cuts[:-1]], cuts, strict=True))
            else:
                ids.update(zip(line, self._encode(line), strict=True))
        return ids

    def _learn(self, runs: list[str]) -> list[bytes]:
        """The ids of runs that are not known; they and the words in them are remembered."""
        out: list[bytes] = [b""] * len(runs)
        cores, single = [], []
        for i, run in enumerate(runs):
            core = run.rstrip(".,")
            if self.PLAIN.fullmatch(core):
                cores.append((i, core.lower(), run[len(core) :]))
            elif run:
                single.append(i)
        for i, ids in zip(single, self._encode([runs[i] for i in single]), strict=True):
            out[i] = ids
        tails = list({t for _, _, t in cores if t})
        after = dict(zip(tails, self._encode(tails), strict=True)) | {"": b""}
        word = self._ids_of(list({low for _, low, _ in cores}))
        for i, low, tail in cores:
            out[i] = word[low] + after[tail]
        own = dict(zip(runs, out, strict=True)) | word
        self.known.add(list(own), list(own.values()))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text begins and the last ends). Runs are numbered by Arrow; each distinct run is looked up once and
        its ids are gathered by number."""
        if not self.by_runs:
            parts = [self._encode([t])[0] for t in texts.to_pylist()]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            return np.frombuffer(b"".join(parts), dtype="<u4"), np.concatenate(([0], np.cumsum(sizes)))
        runs = pc.ascii_split_whitespace(texts)
        numbered = runs.flatten().dictionary_encode()
        words = numbered.dictionary.to_pylist()
        entry = self.known.find(words)
        old, new = entry >= 0, np.flatnonzero(entry < 0)
        # the ids of the runs that are known and behind them those of the runs learned now: a pool of these texts alone, not a copy of all that is known
        begins, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        pool, sizes[old] = self.known.ids(entry[old])
        if len(new):
            learned = self._learn([words[i] for i in new.tolist()])
            sizes[new] = np.fromiter(map(len, learned), np.int64, len(learned)) // 4
            pool = np.concatenate((pool, np.frombuffer(b"".join(learned), dtype="<u4")))
        order = np.concatenate((np.flatnonzero(old), new))
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        codes = numbered.indices.to_numpy()
        own = sizes[codes]
        ends = np.cumsum(own)
        at = np.repeat(begins[codes] - (ends - own), own) + np.arange(int(ends[-1]) if len(ends) else 0)
        cuts = np.concatenate(([0], ends))[runs.offsets.to_numpy() - runs.offsets[0].as_py()]
        return pool[at], cuts
