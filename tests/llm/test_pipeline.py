import corpus_pipeline
import pytest
from odd_rows import LONG, NASTY
from test_minhash import brute_force
from tokenizers import Tokenizer

from isobar.llm import decontamination, toxicity
from isobar.llm.queries import queries, tokenizer_spec
from isobar.session import settle

PATH = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect_one_after_another(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(settle(stage(spark, kept[-1], PATH), f"test-{name}"))
        assert kept[-1].columns == COLUMNS
    first, second, third, fourth, fifth = ([tuple(r) for r in d.collect()] for d in kept)

    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{PATH}/labels.parquet")).collect()}
    assert sorted(second) == sorted(r for r in first if not scores[r[0]])
    groups = brute_force([(r[0], r[1]) for r in second])
    assert sorted(third) == sorted(r for r in second if groups[r[0]][1] == r[0])
    leaks = {r.doc_id for r in decontamination.contaminated(kept[2], spark.read.parquet(f"{PATH}/benchmark.parquet")).collect()}
    assert sorted(fourth) == sorted(r for r in third if r[0] not in leaks)

    words = {r[0]: len(r[1].split()) for r in fourth}
    copies = [r[0] for r in fifth]
    assert {i: copies.count(i) for i in copies}.items() and max(copies.count(i) for i in copies) <= 2
    assert set(fifth) <= set(fourth)
    assert sum(words[i] for i in copies) == pytest.approx(1.5 * sum(words.values()), rel=0.1)

    tokenizer = Tokenizer.from_str(tokenizer_spec())
    at, expected = 0, []
    for row in sorted(fifth):
        n = len(tokenizer.encode(row[1], add_special_tokens=False).ids) + 1
        expected.append((row[0], at, n))
        at += n
    result = corpus_pipeline.run(spark, PATH).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in result) == expected


def test_every_query_has_its_columns(spark):
    expected = {
        "op1_": "doc_id held_out score predicted", "op2_": "doc_id size source_size target taken", "op3_": "page_id url text n_chars",
        "op4_": "doc_id item_id", "op5_": "page_id payload_bytes payload_digest record_type refers_to",
        "op6_": "doc_id size text_crc32 law shard slot grown_shard", "op7_": "doc_id start n_tokens ids_crc32",
        "op8_": "doc_id n_shingles component_id kept", "op9_": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op10_": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op11_": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", "op12_": "doc_id held_out lang_pred score",
        "op13_": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    }
    for start, columns in expected.items():
        (name,) = [n for n in queries() if n.startswith(start)]
        assert set(columns.split()) <= set(queries()[name](spark, PATH).columns)


def odd_documents(spark):
    """Odd rows with columns whose names the stages might use themselves."""
    texts = [*NASTY, (5, "another text of the id five, which is not like the first"), (9, LONG), (9, LONG)]
    more = "n long, i long, s string, copies long, copy string, size_of_text string, row string, id string, words string, size long, source_size long"
    rows = [(i, t, ("en", None)[k % 2], ("a", "b", None)[k % 3], -k, k, k, "s", 7, "c", "z", "r", "id", "w", 5, 6) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {more}")


def whole(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_odd_rows_through_every_stage(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = whole(docs), settle(stage(spark, docs, PATH), f"odd-{name}")
        assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
        assert set(whole(kept)) <= set(before)
        assert whole(stage(spark, docs, PATH)) == whole(kept)
        if name == "near_duplicates":
            ids = [r[0] for r in whole(kept) if r[0] is not None]
            assert len(ids) == len(set(ids)) and 9 not in ids and {1, 2, 3, 4, 6, 7} <= set(ids)
            assert [r for r in whole(kept) if r[0] is None] == [r for r in before if r[0] is None]
        elif name != "mixing":
            assert len(whole(kept)) == len(before) or name == "toxicity"
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, PATH)
    assert last.count() == docs.count()


def test_empty_tables_through_every_stage(spark):
    docs = odd_documents(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, PATH)
        assert result.count() == 0
        docs = docs if "text" not in result.columns else result
