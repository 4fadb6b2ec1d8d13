"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by score, then by
position, and merges the best pair until none forms a piece.  Pieces of such a
vocabulary hold white-space marks only at their front and no line feed, so a
text falls into segments that no merge crosses; this is verified on the
vocabulary, and where it does not hold the text is one segment.  Segments that
recur are encoded once and kept in a bounded table.

Every segment that is encoded is compared with the sentencepiece library, batch
by batch, as is the first text of each slice as a whole; with a vocabulary that
holds a line feed every text is compared as a whole instead.  A difference raises
an error.

Defined results
  * null text: no ids, empty decoded text; empty text the same;
  * very long texts are encoded whole; a segment's agenda needs memory in
    proportion to it;
  * repeated rows are encoded again, extra columns are kept, columns that have
    the result's names are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._store import bound_batches

MARK = "▁"

#: Segments kept in each of two generations of a worker's table.
KEPT = 150_000
#: Longer segments are not kept.
KEPT_CHARS = 64


@dataclass(frozen=True)
class Vocabulary:
    """What the model file says."""

    pieces: list
    scores: dict
    ids: dict
    byte_ids: list
    byte_set: frozenset
    unknown: int
    dummy_prefix: bool
    splits: bool
    line_splits: bool


def read_model(path: str) -> tuple[Vocabulary, object]:
    """The vocabulary and the library's processor for a BPE model file."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        data = f.read()
    proto.ParseFromString(data)
    spec = proto.normalizer_spec
    if proto.trainer_spec.model_type != 2:
        raise ValueError("not a merge-type (BPE) vocabulary")
    if spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models with the identity normaliser are supported")
    if any(p.type in (4, 5) for p in proto.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    pieces = [p.piece for p in proto.pieces]
    normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
    scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
    byte_ids = [-1] * 256
    for i, p in enumerate(proto.pieces):
        if p.type == 6:
            byte_ids[int(p.piece[3:5], 16)] = i
    if -1 in byte_ids:
        raise ValueError("only models with byte fallback are supported")
    vocab = Vocabulary(
        pieces=pieces,
        scores=scores,
        ids=normal,
        byte_ids=byte_ids,
        byte_set=frozenset(byte_ids),
        unknown=next(i for i, p in enumerate(proto.pieces) if p.type == 2),
        dummy_prefix=spec.add_dummy_prefix,
        splits=not any(re.search(f"[^{MARK}]{MARK}", p) for p in normal),
        line_splits=not any("\n" in p for p in normal),
    )
    return vocab, sentencepiece.SentencePieceProcessor(model_proto=data)


def segmenter(v: Vocabulary):
    """Pattern of the segments that no merge crosses."""
    if v.splits and v.line_splits:
        return re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
    if v.splits:
        return re.compile(f"(?s){MARK}+[^{MARK}]*|[^{MARK}]+")
    return re.compile(r"(?s).+")


#: Symbols up to which the agenda is a flat list, searched for its best entry.
FLAT = 40
_NONE = float("-inf")


def merge(v: Vocabulary, text: str) -> list[int]:
    """Ids of one segment, by the agenda: a flat list if short, else a heap."""
    symbols = list(text)
    n = len(symbols)
    if n <= FLAT:
        get = v.scores.get
        agenda = [get(a + b, _NONE) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := max(agenda)) != _NONE:
            i = agenda.index(best)  # the leftmost of equal scores
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(symbols[i] + symbols[i + 1], _NONE)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + symbols[i], _NONE)
    else:
        scores = v.scores
        left = list(range(-1, n - 1))
        right = list(range(1, n + 1))
        right[-1] = -1
        agenda = []
        for i in range(n - 1):
            s = scores.get(symbols[i] + symbols[i + 1])
            if s is not None:
                agenda.append((-s, i, i + 1, len(symbols[i]) + len(symbols[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            a, b = symbols[i], symbols[j]
            if not a or not b or len(a) + len(b) != size:
                continue
            symbols[i], symbols[j] = a + b, ""
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                s = scores.get(symbols[i] + symbols[k])
                if s is not None:
                    heapq.heappush(agenda, (-s, i, k, len(symbols[i]) + len(symbols[k])))
            h = left[i]
            if h >= 0:
                s = scores.get(symbols[h] + symbols[i])
                if s is not None:
                    heapq.heappush(agenda, (-s, h, i, len(symbols[h]) + len(symbols[i])))
    out, ids, byte_ids = [], v.ids, v.byte_ids
    for s in symbols:
        if s:
            i = ids.get(s)
            if i is not None:
                out.append(i)
            else:
                out.extend(byte_ids[x] for x in s.encode("utf-8"))
    return out


def unpiece(v: Vocabulary, ids: list[int]) -> str:
    """Text of ids, white-space marks as spaces, a front space not yet cut."""
    if v.byte_set.isdisjoint(ids):
        return "".join([v.pieces[i] for i in ids]).replace(MARK, " ")
    out, run = [], bytearray()
    byte_of = {i: b for b, i in enumerate(v.byte_ids)}
    for i in ids:
        b = byte_of.get(i)
        if b is not None:
            run.append(b)
            continue
        if run:
            out.append(run.decode("utf-8", "replace"))
            run.clear()
        out.append(v.pieces[i].replace(MARK, " "))
    if run:
        out.append(run.decode("utf-8", "replace"))
    return "".join(out)


class Encoder:
    """Encodes texts; one for each worker process and model."""

    def __init__(self, path: str, kept: int = KEPT):
        self.v, self.library = read_model(path)
        self.pattern = segmenter(self.v)
        self.kept = kept
        self.new: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}

    def normal(self, text: str) -> str:
        if not text:
            return ""
        return (MARK if self.v.dummy_prefix else "") + text.replace(" ", MARK)

    def segments(self, text: str) -> list[str]:
        return self.pattern.findall(self.normal(text))

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for i in merge(self.v, s)]

    def decode(self, ids: list[int]) -> str:
        text = unpiece(self.v, ids)
        return text[1:] if self.v.dummy_prefix and text.startswith(" ") else text

    def learn(self, found: set[str]) -> dict[str, tuple[str, int, str]]:
        """(ids in decimal, their number, decoded text) of these segments."""
        new, old = self.new, self.old
        out, todo = {}, []
        for s in found:
            got = new.get(s)
            if got is None:
                got = old.get(s)
                if got is None:
                    todo.append(s)
                    continue
                new[s] = got
            out[s] = got
        if todo:
            v = self.v
            mine = [merge(v, s) for s in todo]
            self.compare(todo, mine)
            for s, ids in zip(todo, mine):
                out[s] = got = (",".join(map(str, ids)), len(ids), unpiece(v, ids))
                if len(s) <= KEPT_CHARS:
                    new[s] = got
        if len(new) > self.kept:
            self.old, self.new = new, {}
        return out

    def compare(self, segments: list[str], mine: list[list[int]]) -> None:
        """Hold segments against the library, joined by line feeds to long texts.

        Where a piece holds a line feed, segments would merge across them: such a
        vocabulary's texts are compared one by one as wholes.
        """
        if not self.v.line_splits:
            return
        feed = [self.v.byte_ids[10]]
        front = self.library.encode("\n")[:-1]
        at = 0
        while at < len(segments):
            size, to, want = 0, at, list(front)
            while to < len(segments) and (size < 4000 or to == at):
                size += len(segments[to])
                want += feed
                want += mine[to]
                to += 1
            text = "\n" + "\n".join(segments[at:to])
            if self.library.encode(text) != want:
                raise RuntimeError(f"encoding differs from the library's: {text[:200]!r}")
            at = to

    def compare_whole(self, text: str) -> None:
        ids = self.library.encode(text)
        if self.encode(text) != ids or self.decode(ids) != self.library.decode(ids):
            raise RuntimeError(f"encoding differs from the library's: {text[:200]!r}")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


RESULT = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def encode_decode(df: DataFrame, model: str, text: str = "text", only: tuple[str, ...] | None = None, keep_text: bool = True) -> DataFrame:
    """``df`` with token ids, decoded text and their digests.

    ``only`` names the result columns to make (all by default).
    """
    bound_batches(df.sparkSession)
    wanted = [f for f in RESULT.fields if only is None or f.name in only]
    names = {f.name for f in wanted}
    carried = [f for f in df.schema.fields if f.name not in names and (keep_text or f.name != text)]
    schema = T.StructType([*carried, *wanted])

    def run(batches):
        e = encoder(model)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            at = 0
            while at < batch.num_rows:
                to, size = at, 0
                texts = []
                while to < batch.num_rows and size < 1_000_000:
                    t = column[to].as_py() or ""
                    texts.append(t)
                    size += len(t)
                    to += 1
                split = [e.segments(t) for t in texts]
                table = e.learn(set().union(*split))
                for t in texts[:1] if e.v.line_splits else texts:
                    e.compare_whole(t)
                out = {f.name: [] for f in wanted}
                for segs in split:
                    got = [table[s] for s in segs]
                    joined = ",".join([g[0] for g in got])
                    n = sum([g[1] for g in got])
                    if "n_tokens" in out:
                        out["n_tokens"].append(n)
                    if "ids" in out:
                        out["ids"].append([int(x) for x in joined.split(",")] if joined else [])
                    if "ids_sha256" in out:
                        out["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                    if "decoded" in out or "decoded_sha256" in out:
                        d = "".join([g[2] for g in got])
                        d = d[1:] if e.v.dummy_prefix and d.startswith(" ") else d
                        if "decoded" in out:
                            out["decoded"].append(d)
                        if "decoded_sha256" in out:
                            out["decoded_sha256"].append(hashlib.sha256(d.encode()).hexdigest())
                part = batch.slice(at, to - at)
                kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(part.schema.get_field_index(f.name)) for f in carried], *[pa.array(out[f.name], kinds.get(f.name, pa.string())) for f in wanted]],
                    names=[f.name for f in schema.fields],
                )
                at = to

    return df.mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_decode(docs, default_model(), only=("n_tokens", "ids_sha256", "decoded_sha256"), keep_text=False)


ORACLE = None
