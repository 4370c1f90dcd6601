import pytest
from pyspark.sql import functions as F

from subventa.operators import embed as M
from subventa.operators import ingest as I
from subventa.operators.dense import dense_top_k
from subventa.schema import CORPUS
from subventa.sources.snapshots import corpus_table
from tests.test_ingest import batch, record


def counting(path):
    """A model that notes the texts it is asked for."""
    plain = M.hashed_trigram_embedder(8)

    def embed(texts, tasks):
        with open(path, "a", encoding="utf-8") as log:
            log.writelines(f"{task}|{text}\n".replace("\n", " ").strip() + "\n" for text, task in zip(texts, tasks))
        return plain(texts, tasks)

    return embed


def asked(path):
    return sorted(open(path, encoding="utf-8").read().splitlines()) if path.exists() else []


def texts(spark, words):
    return spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, text string")


def test_stored_texts_are_not_asked_for_again(spark, tmp_path):
    store, log = M.vector_store(spark, str(tmp_path / "store"), buckets=4), tmp_path / "log"
    first = M.embed_into(texts(spark, ["a", "b", "b", "query: a"]), store, counting(log))
    assert (first.asked, first.embedded) == (3, 3)
    second = M.embed_into(texts(spark, ["a", "c", "passage: b"]), store, counting(log))
    assert (second.asked, second.embedded) == (1, 1)
    assert M.embed_into(texts(spark, ["c"]), store, counting(log)) == M.Written(0, 0, 0)
    assert asked(log) == ["RETRIEVAL_DOCUMENT|a", "RETRIEVAL_DOCUMENT|b", "RETRIEVAL_DOCUMENT|c", "RETRIEVAL_QUERY|a"]
    found = {r.id: r.embedding for r in M.with_vectors(texts(spark, ["a", "query: a", "new"]), store).collect()}
    assert found[0] == found[1] and found[2] is None  # the stand-in does not tell tasks apart, the store does
    assert store.read().count() == 4
    again = M.embed_into(texts(spark, ["a"]), store, counting(log), again=True)
    assert again.asked == 1 and store.read().count() == 4


def test_ingest_backfill_and_search_form_a_chain(spark, tmp_path):
    now = F.lit("2026-02-01 00:00:00").cast("timestamp")
    corpus, store, log = corpus_table(spark, str(tmp_path / "corpus"), 4), M.vector_store(spark, str(tmp_path / "store"), 4), tmp_path / "log"
    rows = [record(i, f"https://example.test/{i}", title=f"Title {i}", body="Same body" if i < 3 else f"Body {i}") for i in range(6)]
    rows.append(record(9, "https://example.test/copy", title="Title 5", body="Body 5"))
    corpus.append(I.upsert_changes(spark.createDataFrame([], CORPUS), batch(spark, rows), now), 1)
    done = M.backfill_corpus(corpus, store, counting(log))
    assert (done.asked, done.embedded, done.rows) == (6, 6, 7)  # one text is shared
    assert corpus.read().filter("embedding is null").count() == 0
    assert M.backfill_corpus(corpus, store, counting(log)) == M.Written(0, 0, 0)
    # a changed page loses its vector, gets one again, and nothing else is asked for or written
    changed = batch(spark, [record(3, "https://example.test/3", title="Title 3", body="Newer body")])
    corpus.append(I.upsert_changes(corpus.lookup(changed), changed, now), corpus.latest() + 1)
    assert corpus.read().filter("embedding is null").count() == 1
    done = M.backfill_corpus(corpus, store, counting(log))
    assert (done.asked, done.rows, len(asked(log))) == (1, 1, 7)
    mine = corpus.read().filter("source_url = 'https://example.test/3'").select(F.lit(1).alias("qid"), "embedding")
    best = dense_top_k(mine, corpus.read(), 1).join(corpus.read().select("grant_id", "body"), "grant_id").first()
    assert best["body"] == "Newer body"
    refreshed = M.backfill_corpus(corpus, store, counting(log), again=True)
    assert (refreshed.asked, refreshed.rows) == (6, 7)


def test_refused_texts_stay_missing_and_lost_connections_fail(spark, tmp_path, monkeypatch):
    store = M.vector_store(spark, str(tmp_path / "store"), 4)

    def picky(words, tasks):
        if words.str.contains("bad").any():
            raise ValueError("refused")
        return M.hashed_trigram_embedder(8)(words, tasks)

    done = M.embed_into(texts(spark, ["bad one", "good", "fine"]), store, picky)
    assert (done.asked, done.embedded) == (3, 2)

    def lost(words, tasks):
        raise ConnectionError("no route to the model")

    with pytest.raises(Exception, match="no route to the model"):
        M.embed_into(texts(spark, ["other"]), store, lost)
    assert store.read().count() == 2 and store.latest() == 1
