from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pactframe.llm import lines

STRIP = " \t\n\x0b\x0c\r"


def brute(rows, ratio, least, once=False):
    """rows (host, text): what stays of each text; with once, a host's pages of the same lines in the same order count as one."""
    counted = [(h, [x.strip(STRIP) for x in (t or "").split("\n") if x.strip(STRIP)]) for h, t in rows]
    if once:
        counted = [(h, list(ls)) for h, ls in {(h, tuple(dict.fromkeys(ls))) for h, ls in counted}]
    pages, seen = Counter(h for h, _ in counted), defaultdict(Counter)
    for h, ls in counted:
        seen[h].update(set(ls))
    gone = {h: {k for k, n in c.items() if n >= least and n > ratio * pages[h]} for h, c in seen.items()}
    return [None if t is None else "\n".join(x for x in t.split("\n") if x.strip(STRIP) not in gone[h]) for h, t in rows]


def test_agrees_with_brute_force(spark, sf, monkeypatch):
    rows = [(r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(None, "menu\nbody 1"), (None, " menu\t\nbody 2\n\n"), (None, "menu\nmenu\nbody 3"), ("few", "x\ny"), ("few", "x"), ("src1", None), ("src1", ""), ("src1", "\n")]
    df = spark.createDataFrame([(h, t, "extra") for h, t in rows], "source string, text string, n_lines string")
    for limit in (lines.BROADCAST_BYTES, 0):
        monkeypatch.setattr(lines, "BROADCAST_BYTES", limit)
        got = lines.drop_boilerplate(df)
        assert got.columns == ["source", "text", "n_lines", "n_removed"]
        want = sorted(zip([str(h) for h, _ in rows], map(str, brute(rows, 0.05, 3))))
        assert sorted((str(r.source), str(r.text)) for r in got.collect()) == want
    assert lines.drop_boilerplate(df.limit(0)).count() == 0


def test_hosts_of_urls(spark):
    df = spark.createDataFrame([(f"http://a.example/{i}", f"nav\npage {i}") for i in range(5)], "url string, text string")
    got = lines.drop_boilerplate(df, host=F.parse_url("url", F.lit("HOST")))
    assert sorted(r.text for r in got.collect()) == [f"page {i}" for i in range(5)]
