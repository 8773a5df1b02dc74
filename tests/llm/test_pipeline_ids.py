from zlib import crc32

import corpus_pipeline


def test_packed_sequences_can_be_read(spark, sample):
    rows = corpus_pipeline.packing_stage(spark, sample("documents"), "").collect()
    assert rows and all(crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
