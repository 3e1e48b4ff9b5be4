"""Language identification: held-out accuracy, clean documents, and rough rows."""

from foliospark.llm import language_id as L


def test_held_out_rows_and_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = L.identify(docs.where("doc_id % 2 = 1"), labelled=docs.where("doc_id % 2 = 0")).collect()
    for found, right, kept in ((rows, 0.98, 0.99), ([r for r in rows if len(r.text) < 100], 0.93, 0.95)):
        assert sum(r.predicted_lang == r.lang for r in found) > right * len(found)
        assert sum(r.lang_keep for r in found) > kept * len(found)


def test_sizes_are_those_of_plain_compression():
    import zstandard

    texts = {"a": b"some words of one kind " * 30, "b": b"andere Worte einer Art " * 30}
    own = L.Classifier(texts, 0.01)
    for text in ("some words of one kind, andere Worte", "x" * 10_000, "y" * L.SHORT_BYTES, "Worte " * 51):
        want = []
        for lang, data in texts.items():
            raw = text.lower().encode()
            short = len(raw) <= L.SHORT_BYTES
            pack = zstandard.ZstdCompressor(level=L.SHORT_LEVEL if short else L.LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            primer = data[-L.PRIMER_BYTES :] if short else b""
            own_cost = len(pack.compress(primer)) if short else 0
            want.append((sum(len(pack.compress(primer + raw[i : i + L.PIECE_BYTES])) - own_cost for i in range(0, len(raw), L.PIECE_BYTES)), lang))
        assert own.sizes(text) == sorted(want)
    assert own("words of one kind and some words of one kind")[::2] == ("a", True)


def test_stretches_and_their_order():
    assert L.stretches("Ab\n\ncd " + "e" * 2000) == ["ab", "cd", "e" * 1024, "e" * 976]
    assert "".join(L.stretches("word " * 500)).replace(" ", "") == "word" * 500 and max(map(len, L.stretches("word " * 500))) <= L.STRETCH
    assert L.interleaved([["a", "bbbb"], ["cc", "d"]], 100) == b"a\ncc\nbbbb\nd"
    assert L.interleaved([["a" * 50, "b"], ["c" * 8, "d"], []], 60) == b"a" * 50 + b"\n" + b"c" * 8
    assert L.interleaved([["ab"]], 100) == b"abababab" and L.interleaved([[]], 9) == b""


def test_dictionaries_are_repeatable_with_clashing_identifiers(spark):
    rows = [(i % 4, "ab"[i % 2], f"row {i} has its own words {i * 7919}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    first = L.fit_dictionaries(docs, per_language=2)
    assert first == L.fit_dictionaries(docs.repartition(7).sortWithinPartitions("text"), per_language=2) == L.fit_dictionaries(docs.coalesce(1), per_language=2)
    assert len(first) == 2


def test_a_label_of_a_few_bytes_has_a_dictionary(spark):
    docs = spark.createDataFrame([(1, "a", "ja"), (2, "b", "some more words of a language")], "doc_id bigint, lang string, text string")
    assert L.fit_dictionaries(docs) == {"a": b"jajajaja", "b": b"some more words of a language"}


def test_rough_rows(rough, none):
    got = L.identify(rough).collect()
    assert len(got) == 9
    for i in (2, 3, 5):
        assert got[i]["predicted_lang"] is None and not got[i]["lang_keep"]
    assert got[0] == got[1] and got[6]["predicted_lang"] == "en"
    assert L.identify(none).collect() == [] and L.stage(none).collect() == []
    assert L.stage(rough).columns == [c for c in rough.columns if c != "predicted_lang"]


def test_without_labels_all_is_rejected_and_ties_are(spark, rough):
    from pyspark.sql import functions as F

    bare = rough.select("doc_id", rough["n_chars"], F.lit(None).cast("string").alias("lang"), F.lit("words").alias("text"))
    assert not any(r.lang_keep for r in L.identify(bare).collect())
    assert L.Classifier({"a": b"same same same", "b": b"same same same"}, 0.001)("same words") [1:] == (0.0, False)


def test_every_label_has_a_dictionary(spark):
    import random

    def text(rng, words):
        return "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(6))

    rows = []
    for n in range(70):
        rng = random.Random(n)
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(40)]
        # The labels differ in frequency, so that a cap would take the last ones.
        rows += [(100 * n + i, f"l{n:02}", text(rng, words)) for i in range(3 + (n < 40))]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    assert sorted(L.fit_dictionaries(docs)) == [f"l{n:02}" for n in range(70)]
    got = L.identify(docs).collect()
    assert len(got) == len(rows) and all(r.predicted_lang == r.lang and r.lang_keep for r in got)
    assert L.stage(docs).count() == len(rows)


def test_a_label_keeps_its_rows_where_identifiers_are_shared(spark):
    docs = spark.createDataFrame([(1, "a", "some words of a kind"), (1, "b", "andere Worte einer Art")], "doc_id bigint, lang string, text string")
    assert L.fit_dictionaries(docs) == {"a": b"some words of a kind", "b": b"andere worte einer art"}
