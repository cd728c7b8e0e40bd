"""Exact token counts of whole texts, huge ones in overlapping chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, table, texts
from tessera.llm.tokens import vocabulary

#: Texts of more characters than this are encoded in chunks of about this size.
CHUNK = 32_768
OVERLAP = 256
LIMIT = 4096

_COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_chunks", pa.int64())])


class PieceCounter:
    """Numbers of ids as a sentencepiece model gives them for whole texts.

    A position between a character other than a blank and a blank is a stable boundary if no piece
    has a blank after another character, the normaliser changes nothing, and there are no
    user-defined symbols: then no merge can reach across it, and what stands left of it does not
    change what stands right of it. Without this proof (it is looked up in the model's own
    pieces) texts are always encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal, pieces = model.normalizer_spec, model.pieces
        self.stable = (
            normal.name == "identity"
            and not normal.precompiled_charsmap
            and not normal.remove_extra_whitespaces
            and not any(p.type == proto.ModelProto.SentencePiece.USER_DEFINED for p in pieces)
            and not any("▁" in p.piece.lstrip("▁") for p in pieces if p.type == proto.ModelProto.SentencePiece.NORMAL)
            and model.trainer_spec.model_type == proto.TrainerSpec.BPE
            and not model.trainer_spec.treat_whitespace_as_suffix
        )

    def starts(self, data: bytes) -> np.ndarray:
        """Where each piece of a UTF-8 text begins, in bytes."""
        return np.array([p.begin for p in self.processor.encode(data.decode("utf-8"), return_type="proto").pieces], np.int64)

    def batch(self, some: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
        """(ids, chunks) of each text."""
        short = [k for k, t in enumerate(some) if len(t) <= chunk or not self.stable]
        found = [(0, 0)] * len(some)
        for k, ids in zip(short, self.processor.encode([some[k] for k in short], num_threads=1)):
            found[k] = (len(ids), 1)
        for k in set(range(len(some))) - set(short):
            found[k] = self.huge(some[k].encode("utf-8"), chunk, overlap)
        return found

    def huge(self, data: bytes, chunk: int, overlap: int) -> tuple[int, int]:
        """Count over overlapping chunks, spliced at boundaries that both encodings have and that are stable.

        The overlap is encoded to find the seam; the next chunk, which is counted, must then have the
        seam among its own boundaries, or it begins further to the left.
        """

        def letter(at: int) -> int:
            while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
                at -= 1
            return at

        total = chunks = 0
        begin = cut = 0  # the chunk begins at begin; its ids count from cut on
        width, lead = chunk, 1
        while True:
            end = letter(min(len(data), begin + width))
            here = begin + self.starts(data[begin:end])
            if begin and cut not in here:
                lead *= 2  # the seam isn't a boundary of the encoding that counts: begin earlier
                begin = letter(max(0, cut - lead))
                continue
            if end == len(data):
                return total + int((here >= cut).sum()), chunks + 1
            seam, over = None, overlap
            while seam is None and end - over > cut:
                left = letter(end - over)
                ahead = left + self.starts(data[left : letter(min(len(data), left + 2 * over))])
                both = np.intersect1d(here[here > left], ahead)
                seam = next((int(x) for x in both[::-1] if x < end and self.apart(data, int(x))), None)
                over *= 2  # no common stable boundary in the overlap: widen it
            if seam is None:
                width *= 2  # none in the whole chunk: take a longer one
                continue
            total += int(((here >= cut) & (here < seam)).sum())
            chunks += 1
            # the model puts a blank of its own before a chunk: begin one letter early, count from the seam
            begin, cut, width, lead = letter(seam - 1), seam, chunk, 1

    @staticmethod
    def apart(data: bytes, at: int) -> bool:
        """A blank, behind something else (the model reads U+2581 as a blank)."""
        return data[at] == 32 and data[at - 1] != 32 and data[max(0, at - 3) : at] != "▁".encode()


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_chunks) for every row of docs (doc_id, text).

    n_tokens is what the sentencepiece model at the path model gives for the whole text, without
    begin or end symbols; a null text is empty (0). Null doc_ids and repeated rows come out as they
    are, an empty table gives an empty one, further columns are ignored.
    """

    def run(batches):
        counter = PieceCounter(model)
        for whole in batches:
            for b in small_batches(whole, "text", 2 << 20):
                some = b.column("text").to_pylist()
                n, chunks = zip(*counter.batch(some, chunk, overlap))
                size = pc.binary_length(b.column("text")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n, pa.int64()), pa.array(chunks, pa.int64())], schema=_COUNTED)

    found = texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_chunks long")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")


def op6_resynchronised_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token count of every document of the table documents."""
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
