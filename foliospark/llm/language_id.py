"""Language identification by compression: the language whose dictionary packs a text smallest.

For each language, lines of a bounded sample of labelled rows become a raw-content zstandard dictionary. A text
is compressed with each, in pieces so short that the dictionary and not the text itself explains them, and the
sums are compared. The best language stands if the runner-up needs at least ``margin`` more, else it is rejected.

A text of SHORT_BYTES or less follows a primer, the dictionary's last bytes, whose own cost is taken off, and is searched
for matches more thoroughly: alone, a text of a few words would be stored as it is and cost the same in every language.
"""

from __future__ import annotations

import re
from itertools import groupby, zip_longest

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliospark.llm.common import chunks, cut, inner, only, table

LEVEL, SHORT_LEVEL, SHORT_BYTES, PIECE_BYTES, PRIMER_BYTES = 6, 12, 300, 4096, 256
#: Share by which the runner-up must be larger.
MARGIN = 0.005
#: Bounds of what the fit sees of a language: labelled rows, and bytes of their lines in its dictionary.
PER_LANGUAGE, DICTIONARY_BYTES = 60, 1 << 16
#: Characters of a stretch of text that is taken or left as a whole; longer lines are several.
STRETCH = 1024
_STRETCH = re.compile(rf"[^\n]{{1,{STRETCH}}}(?=\s|$)|[^\n]{{1,{STRETCH}}}")


def stretches(text: str) -> list[str]:
    """The lines of a text in lower case, long ones cut at blanks where there are any."""
    return _STRETCH.findall(text.lower())


def interleaved(texts: list[list[str]], most: int) -> bytes:
    """Stretches of the texts in turn, each whole, until the next would make more than ``most`` bytes; of a few bytes, over and over.

    The compressor takes no dictionary of fewer than 8 bytes.
    """
    out, size = [], 0
    for line in (x for turn in zip_longest(*texts) for x in turn if x is not None):
        if (size := size + len(line.encode()) + 1) > most + 1:
            break
        out.append(line)
    data = "\n".join(out).encode()
    return data * (-(-8 // len(data))) if data else b""


def fit_dictionaries(docs: DataFrame, per_language: int = PER_LANGUAGE, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each language in docs.lang, from at most ``per_language`` rows of each, those of the least hash.

    These bounds are what the fit may see of a language; every label counts, however many there are. The
    choice reads only doc_id and lang and keeps a few rows a partition. A chosen row is cut into stretches where it is read,
    of which as many as a dictionary could hold come to the driver, a language at a time. Where an identifier has
    several texts in a language, the least stands. Rows without a label, an identifier or a text don't take part.
    """
    docs = only(docs, "doc_id", "lang", "text").where("doc_id is not null and lang is not null and text is not null")
    ranked = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = docs.select("doc_id", "lang").withColumn("at", F.row_number().over(ranked)).where(F.col("at") <= per_language).select("doc_id", "lang").distinct()
    chosen, _ = cut(chosen)  # so that its size decides how it is joined
    rows = docs.join(chosen, ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def cut_up(batches):
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                mine, size = [], 0
                for line in stretches(text):
                    if (size := size + len(line.encode()) + 1) > dictionary_bytes:
                        break
                    mine.append(line)
                out.append(mine)
            yield pa.record_batch([b.column("lang"), b.column("doc_id"), pa.array(out, pa.list_(pa.string()))], names=["lang", "doc_id", "lines"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(cut_up, f"lang string, doc_id {kind}, lines array<string>").orderBy("lang", "doc_id")
    made = ((lang, interleaved([r.lines for r in own], dictionary_bytes)) for lang, own in groupby(found.toLocalIterator(), key=lambda r: r.lang))
    return {lang: d for lang, d in made if d}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], margin: float):
        self.margin, self.packers, self.short = margin, [], []
        for lang, data in sorted(dictionaries.items()):
            self.packers.append((lang, self._packer(data, LEVEL)))
            pack, primer = self._packer(data, SHORT_LEVEL), data[-PRIMER_BYTES:]
            self.short.append((lang, pack, primer, len(pack(primer))))

    @staticmethod
    def _packer(data: bytes, level: int):
        own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def sizes(self, text: str) -> list[tuple[int, str]]:
        """Compressed bytes, without the primer's, and language, the smallest first, equal ones by name."""
        data = text.lower().encode()
        if len(data) <= SHORT_BYTES:
            return sorted((len(pack(primer + data)) - own, lang) for lang, pack, primer, own in self.short)
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        return sorted((sum(map(len, map(pack, pieces))), lang) for lang, pack in self.packers)

    def __call__(self, text: str | None) -> tuple[str | None, float | None, bool]:
        """Best language, its margin, and whether it stands."""
        if not text or text.isspace() or not self.packers:
            return None, None, False
        sizes = self.sizes(text)
        gap = 1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / max(1, sizes[0][0])
        return sizes[0][1], gap, gap >= self.margin


def on_worker(shared) -> Classifier:
    if (made := getattr(shared, "_made", None)) is None:
        made = shared._made = Classifier(*shared.value)
    return made


ADDED = ("predicted_lang", "lang_margin", "lang_keep")


def _found(docs: DataFrame, labelled: DataFrame | None, margin: float, **fit) -> tuple[DataFrame, list[str]]:
    """The result under inner names, then ADDED; and the columns' own names."""
    shared = docs.sparkSession.sparkContext.broadcast((fit_dictionaries(docs if labelled is None else labelled, **fit), margin))
    docs, names = inner(docs, *ADDED)
    at = names.index("text")

    def run(batches):
        own = on_worker(shared)
        for b in chunks(batches, at):
            codes = b.column(at).dictionary_encode()  # texts that are alike are packed once
            each = [own(t) for t in codes.dictionary.to_pylist()]
            found = [(None, None, False) if i is None else each[i] for i in codes.indices.to_pylist()]
            yield pa.record_batch(
                [*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                names=[*b.schema.names, *ADDED],
            )

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *map(T.StructField, ADDED, kinds)])), names


def identify(docs: DataFrame, labelled: DataFrame | None = None, margin: float = MARGIN, **fit) -> DataFrame:
    """All columns of docs, then predicted_lang, lang_margin and lang_keep, for every row.

    The dictionaries come from ``labelled`` (docs itself if None; see fit_dictionaries) and are broadcast: 64 KB a
    language, whatever the data. One narrow Arrow pass, no shuffle. A null, empty or blank text is rejected with
    null language and margin, and so is every text when no row is labelled; a tie has margin 0 and is rejected,
    which a text of a few bytes often is; with one language all else stands. Repeated rows get equal results; long
    texts count whole; columns of docs that have the new names already are replaced; no rows give no rows.
    """
    found, names = _found(docs, labelled, margin, **fit)
    return found.toDF(*names, *ADDED)


def stage(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language stands, with the columns they have; lang becomes the language found.

    Null, empty and blank texts are rejected and go, ties too; all else as in identify. Columns named like identify's new ones aren't kept.
    """
    found, names = _found(docs, None, MARGIN)
    found = found.where("lang_keep")
    if "lang" in names:
        found = found.withColumn(f"_{names.index('lang')}", F.col("predicted_lang"))
    return found.drop(*ADDED).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs).select("doc_id", F.col("lang").alias("given_lang"), "predicted_lang", "lang_margin", F.col("lang_keep").alias("keep"))
