"""How much goes to a Python worker together."""

import pyarrow as pa
import corpus_pipeline as P

from lexspan.llm import common, jaccard


def _largest(df):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    return max(r.bytes for r in df.mapInArrow(sizes, "n long, bytes long").collect())


def test_documents_go_to_workers_in_small_batches(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat(concat('word', id % 7, ' '), 9000) AS text", "'en' AS lang", "'a' AS source", "0L AS n_chars").coalesce(1)
    try:
        for run in (lambda: jaccard.jaccard_components(docs), lambda: P.STAGES[3][1](spark, docs, "")):
            spark.conf.unset(common.BATCH_CONF)
            run()
            assert _largest(docs) < 2 * common.BATCH_BYTES < 300 * 9000 * 6 // 3
            spark.conf.set(common.BATCH_CONF, str(8 << 20))  # what the session says stays
            run()
            assert spark.conf.get(common.BATCH_CONF) == str(8 << 20)
    finally:
        spark.conf.unset(common.BATCH_CONF)


def test_components_dont_depend_on_the_batches(spark):
    docs = spark.range(60).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 40), i -> concat('w', i * (id % 6 + 1)))) || if(id % 2 = 0, ' x', '') AS text").coalesce(2)
    got = []
    try:
        for size in (1, 1 << 26):
            spark.conf.set(common.BATCH_CONF, str(size))
            got.append(sorted(map(tuple, jaccard.jaccard_components(docs).collect())))
    finally:
        spark.conf.unset(common.BATCH_CONF)
    assert got[0] == got[1] and len({r[2] for r in got[0]}) < 60


def test_scratch_tables_have_small_row_groups(spark):
    import pyarrow.parquet as pq

    kept = common.materialize(spark.range(3000).selectExpr("id", "array_join(transform(sequence(0, 40), i -> sha2(concat(id, '-', i), 512)), '') AS text").coalesce(1), "row-groups")
    (path,) = kept.inputFiles()
    meta = pq.ParquetFile(path.removeprefix("file://")).metadata
    assert meta.num_row_groups > 1 and max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 2 * common.ROW_GROUP
    assert kept.count() == 3000
