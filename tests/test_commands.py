import gzip

import pytest
from test_sources import classic, level, segment, udp

from ledgerlight.__main__ import main
from ledgerlight.operators import books
from ledgerlight.sources import itch, synthetic, tables


@pytest.mark.parametrize("symbols, seed", [(3, 20), (1, 99)])
def test_a_feed_replays_to_its_truth(spark, tmp_path, symbols, seed):
    feed, truth = str(tmp_path / "feed.itch"), str(tmp_path / "truth.csv")
    n = synthetic.write(feed, truth, 4000, symbols=symbols, seed=seed)
    frames = itch.read_frames(spark, feed).cache()
    stats = itch.parse_stats(frames).first()
    assert stats.messages == n and not stats.unknown_type + stats.framing_errors + stats.length_mismatch + stats.truncated_tail
    mine = books.resolved(itch.decode(frames), ["SYN"])
    events = books.order_book_events(mine, ["symbol"]).cache()
    told = tables.read_truth(spark, truth)
    assert events.count() == told.count() > 1000 and books.verify(events, told).count() == 0
    assert books.diagnostics(events, ["symbol"]).first().corruption == 0
    assert books.verify(events, told.where("seq <> 5")).count() > 0


def test_replay_and_generate(spark, tmp_path, capsys):
    feed, truth = str(tmp_path / "f.itch"), str(tmp_path / "t.csv")
    assert main(["generate", "--out", feed, "--truth", truth, "--messages", "500", "--seed", "3"]) == 0
    assert main(["replay", "--feed", feed, "--symbol", "SYN", "--truth", truth]) == 0 and "PASS" in capsys.readouterr().out
    lines = open(truth).read().splitlines()
    open(truth, "w").write("\n".join(lines[:-3]) + "\n")
    assert main(["replay", "--feed", feed, "--symbol", "SYN", "--truth", truth, "--quiet"]) == 1 and "FAIL" in capsys.readouterr().out


def test_fetch(spark, tmp_path):
    S = 1_000_000_000
    sent = [level("AAA", "B", 1_000_000, 100, ts=S), level("AAA", "S", 1_000_200, 100, ts=3 * S), level("BBB", "B", 5, 5, ts=3 * S)]
    (tmp_path / "good.pcap.gz").write_bytes(gzip.compress(classic([udp(segment(sent, 1))])))
    (tmp_path / "gap.pcap").write_bytes(classic([udp(segment(sent[:1], 1)), udp(segment(sent[1:], 9))]))
    (tmp_path / "bad.pcap").write_bytes(b"nothing of this kind")
    out = str(tmp_path / "features" / "20200102.csv.gz")
    assert main(["fetch", "--pcap", str(tmp_path / "good.pcap.gz"), "--symbols", "AAA", "--out", out]) == 0
    rows = tables.read_features(spark, [out]).orderBy("seq").collect()
    assert [(r.ts_ns, r.symbol, r.bid, r.ask, r.spread, r.date) for r in rows] == [(3 * S, "AAA", 1_000_000, 1_000_200, 200, "20200102")] * 2
    assert main(["fetch", "--pcap", str(tmp_path / "gap.pcap"), "--symbols", "AAA", "--out", out]) == 1
    assert main(["fetch", "--pcap", str(tmp_path / "bad.pcap"), "--symbols", "AAA", "--out", out]) == 2
