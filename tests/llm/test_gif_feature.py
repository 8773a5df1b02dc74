import pyarrow as pa
from test_lines_media_html import picture

from ledgerlight.llm import media


def test_the_feature_counts_composed_colours(monkeypatch):
    data = picture(2, 2, [(0, 0, [[1, 1], [1, 1]], 5, 1, None, None, 0), (0, 0, [[2, 0], [0, 2]], 7, 3, 0, None, 0)])
    monkeypatch.setattr(media, "stored", lambda text: (data, 0))
    out = next(media.digests(iter([pa.record_batch({"doc_id": [1], "text": ["x"]})])))
    assert out.column("feature")[0].as_py() == "frames=2;cs=12;grey=2,0,0,0,0,0,0,6"
