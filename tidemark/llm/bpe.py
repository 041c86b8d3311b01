"""BPE encoding and decoding by a pair occurrence index.

The distinct words of a batch stand in one array of symbols. An index maps every pair that has a merge rank to all its
positions in the array. The active ranks are applied in ascending order, each to all its positions at once; the links to
the neighbours and the lists of the pairs that arise are updated. Words are remembered between batches, within a bound.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import frugal, pieces

#: Texts of these characters alone need no normalisation but lower case, and split into words at white space. (The
#: capital I with a dot is left out: in lower case it is two characters.)
PLAIN = r"[\t-\r -~\xa0-įı-ɏ]*"
#: Words that a Python worker remembers, and words that are encoded together.
REMEMBERED, TOGETHER = 600_000, 200_000
#: Bytes of text that are encoded together.
BYTES = 6_000_000
#: The split pattern and the normalisation that this encoder knows (fixed values of the tokenizer files).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def lay(ids, start, size):
    """The stretches ids[start : start + size] in a row."""
    import numpy as np

    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return ids[np.repeat(start - (end - size), size) + np.arange(total)]


class Words:
    """The ids of the words of earlier batches; those of the last one alone once there are too many."""

    def __init__(self):
        import numpy as np
        import pyarrow as pa

        # The empty word stands before and behind the white space at the ends of a text.
        self.known, self.size, self.ids = pa.array([""]), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def join(self, texts: list[str], learn: Callable) -> list[bytes]:
        """The ids of each plain text. learn takes an array of words and gives the number of ids of each, and all ids.

        Words stay in Arrow and ids in numpy: a text's ids are laid out by the numbers of its words.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return []
        split = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        coded = split.flatten().dictionary_encode()
        words, place = coded.dictionary, np.asarray(coded.indices)
        at = pc.index_in(words, value_set=self.known)
        lost = words.filter(pc.is_null(at))
        if len(lost):
            size, ids = learn(lost)
            if len(self.known) + len(lost) > REMEMBERED:
                old = np.asarray(at.drop_null())
                start = np.cumsum(self.size) - self.size
                kept = self.known.take(pa.array(old))
                self.ids, self.size, self.known = lay(self.ids, start[old], self.size[old]), self.size[old], kept
            self.known = pa.concat_arrays([self.known, lost])
            self.size, self.ids = np.append(self.size, size), np.append(self.ids, ids)
            at = pc.index_in(words, value_set=self.known)
        number = np.asarray(at)[place]
        start = np.cumsum(self.size) - self.size
        size = self.size[number]
        data = lay(self.ids, start[number], size).tobytes()
        cut = (np.append(0, np.cumsum(size))[np.asarray(split.offsets) - split.offsets[0].as_py()] * 4).tolist()
        return [data[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]


class Bpe:
    """One tokenizer file of the kind `word_bpe_49k.json`, without its truncation and padding."""

    def __init__(self, spec: str | bytes):
        import numpy as np
        import regex
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        spec = json.loads(spec)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("decoder") or model.get("dropout") or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != SPLIT:
            raise ValueError("a tokenizer file of another kind")
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes | None] = [None] * size
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token.encode()
        suffix = model.get("end_of_word_suffix") or ""
        shown = byte_symbols()
        self.inner = np.array([self.vocab[x] for x in shown], np.int64)
        self.last = np.array([self.vocab[x + suffix] for x in shown], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = np.array([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs], np.int64)
        made = {}
        for rank, (a, b, new) in enumerate(ids.tolist()):
            if max(made.get(a, -1), made.get(b, -1)) >= rank or new in made:
                raise ValueError("merges whose parts come later can't be applied rank by rank")
            made[new] = rank
        self.left, self.right, self.new = ids.T
        keys = self.left * size + self.right
        self.size, self.order = size, np.argsort(keys)
        self.keys = keys[self.order]
        self.split = regex.compile(SPLIT)
        # Beyond PLAIN, Unicode tables differ between versions; there the library's own normalise and split.
        self.normalize = Tokenizer.from_str(json.dumps(spec)).normalizer.normalize_str
        self.split_odd = Split(Regex(SPLIT), "removed", invert=True).pre_tokenize_str
        self.plain = regex.compile(PLAIN).fullmatch
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = Words()

    def _ranks(self, left, right):
        """The merge rank of every pair, -1 without one."""
        import numpy as np

        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.order[at], -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each non-empty word, as little-endian unsigned 32-bit integers."""
        import numpy as np

        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        first, last = end - size, end - 1
        symbols = np.frombuffer(b"".join(words), np.uint8)
        n = len(symbols)
        sym = np.append(self.inner[symbols], -1)  # the place n stands for the edge of a word
        sym[last] = self.last[symbols[last]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[last], before[first] = n, n

        index: dict[int, list] = {}
        active: list[int] = []

        def note(ranks, places) -> None:
            """Add the places to the lists of their pairs."""
            known = ranks >= 0
            ranks, places = ranks[known], places[known]
            if not len(ranks):
                return
            by = np.argsort(ranks, kind="stable")
            ranks, places = ranks[by], places[by]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, p in zip(ranks[np.append(0, cut)].tolist(), np.split(places, cut), strict=True):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(active, r)

        places = np.arange(n)
        note(self._ranks(sym[:-1], sym[after[:-1]]), places)
        while active:
            rank = heapq.heappop(active)
            p = index.pop(rank)
            p = np.unique(np.concatenate(p)) if len(p) > 1 else p[0]
            a, b, new = self.left[rank], self.right[rank], self.new[rank]
            p = p[(sym[p] == a) & (sym[after[p]] == b)]
            if a == b and len(p) > 1:  # in a run of equal symbols every other pair, from the left
                start = np.append(True, after[p[:-1]] != p[1:])
                p = p[(np.arange(len(p)) - np.flatnonzero(start)[np.cumsum(start) - 1]) % 2 == 0]
            if not len(p):
                continue
            gone = after[p]
            far = after[gone]
            sym[p], sym[gone] = new, -1
            after[p], before[far] = far, p
            near = before[p]
            note(self._ranks(sym[near], sym[p]), near)
            note(self._ranks(sym[p], sym[far]), p)
        alive = sym[:-1] >= 0
        ids = sym[:-1][alive].astype("<u4").tobytes()
        stop = np.cumsum(alive)[last] * 4
        return [ids[i:j] for i, j in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]

    def _learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        pieces, out = list(pieces), {}
        for at in range(0, len(pieces), TOGETHER):
            some = pieces[at : at + TOGETHER]
            out.update(zip(some, self.merge([p.encode() for p in some]), strict=True))
        return out

    def _odd(self, text: str) -> list[str | int]:
        """The pieces of a text of any characters, special tokens as ids."""
        out: list[str | int] = []
        at = 0
        for m in [*(self.specials.finditer(text) if self.specials else ()), None]:
            if part := text[at : m.start() if m else len(text)]:
                out += [p for p, _ in self.split_odd(self.normalize(part))]
            if m:
                out.append(self.special[m.group()])
                at = m.end()
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        import pyarrow.compute as pc

        texts = [t or "" for t in texts]
        plain = [bool(self.plain(t)) and not (self.specials and self.specials.search(t)) for t in texts]
        parts = [None if p else self._odd(t) for t, p in zip(texts, plain, strict=True)]
        odd = self._learn({x for ws in parts if ws for x in ws if isinstance(x, str)})

        def learn(words):
            import numpy as np

            split = [self.split.findall(w) for w in pc.utf8_lower(words).to_pylist()]
            known = self._learn({x for ps in split for x in ps})
            ids = [known[ps[0]] if len(ps) == 1 else b"".join([known[x] for x in ps]) for ps in split]
            return np.array([len(x) // 4 for x in ids], np.int64), np.frombuffer(b"".join(ids), "<u4")

        easy = iter(self.words.join([t for t, p in zip(texts, plain, strict=True) if p], learn))
        return [next(easy) if ws is None else b"".join([odd[x] if isinstance(x, str) else x.to_bytes(4, "little") for x in ws]) for ws in parts]

    def decode(self, ids: bytes) -> bytes:
        """The text of the ids in UTF-8, special tokens included; unknown ids are left out.

        These files name no decoder, so the tokens stand as they are in the vocabulary, with spaces between.
        """
        import numpy as np

        tokens = self.tokens
        found = np.frombuffer(ids, "<u4").tolist()
        try:
            return b" ".join(map(tokens.__getitem__, found))
        except (IndexError, TypeError):
            return b" ".join(tokens[i] for i in found if i < len(tokens) and tokens[i] is not None)


_LOADED: dict[str, object] = {}


def loaded(make, spec: bytes):
    """make(spec), once for each Python worker."""
    key = f"{make.__name__}:{hashlib.sha256(spec).hexdigest()}"
    if key not in _LOADED:
        _LOADED[key] = make(spec)
    return _LOADED[key]


def read_spec(spark: SparkSession, path: str):
    """The tokenizer file, sent once to each executor; its size is that of one vocabulary."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the binary column `out`: the ids of `text` as little-endian unsigned 32-bit integers."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    keep = [f for f in docs.schema.fields if f.name != out]
    spec = read_spec(docs.sparkSession, path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = loaded(Bpe, spec.value)
        for b in pieces(batches, text, BYTES):
            ids = pa.array(bpe.encode_batch(b.column(text).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), ids], names=[f.name for f in keep] + [out])

    return docs.select(*(f.name for f in keep)).mapInArrow(frugal(run), StructType([*keep, StructField(out, BinaryType())]))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the string column `out`: the text of the ids, special tokens included (null ids: empty)."""
    from pyspark.sql.types import StringType, StructField, StructType

    keep = [f for f in rows.schema.fields if f.name != out]
    spec = read_spec(rows.sparkSession, path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = loaded(Bpe, spec.value)
        for b in pieces(batches, ids, BYTES):
            texts = [bpe.decode(x or b"").decode() for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(texts, pa.string())], names=[f.name for f in keep] + [out])

    return rows.select(*(f.name for f in keep)).mapInArrow(frugal(run), StructType([*keep, StructField(out, StringType())]))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 for every row, encoded, then decoded from the ids; the ids if wanted.

    Decoded texts live only within their task, as do the ids unless they are wanted.
    Defined cases: a null text is empty and has no tokens; a null id stays null; repeated rows give repeated results;
    other columns are ignored; an empty table gives no rows; texts may have any length and any characters.
    """
    spec = read_spec(docs.sparkSession, path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = loaded(Bpe, spec.value)
        for b in pieces(batches, "text", BYTES):
            found = bpe.encode_batch(b.column("text").to_pylist())
            columns = [b.column("id"), pa.array([len(ids) // 4 for ids in found], pa.int64())]
            columns.append(pa.array([hashlib.sha256(ids).hexdigest() for ids in found], pa.string()))
            columns.append(pa.array([hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in found], pa.string()))
            columns += [pa.array(found, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.selectExpr(f"`{id_col}` as id", f"`{text}` as text").mapInArrow(frugal(run), schema)
