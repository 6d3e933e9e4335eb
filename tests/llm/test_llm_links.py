"""Union-find in chunks of links: chunks stay bounded when all links share a hub."""

from phasemill.llm import superminhash


def test_links_of_one_hub_are_dealt_over_chunks(spark, monkeypatch):
    union = superminhash._union

    def bounded(pdf):
        if len(pdf) > 300:
            raise ValueError(f"{len(pdf)} links in one chunk")
        return union(pdf)

    monkeypatch.setattr(superminhash, "CHUNK_LINKS", 100)
    monkeypatch.setattr(superminhash, "_union", bounded)
    star = [(0, n) for n in range(1, 2001)] + [(3000, 3001), (3001, 3002), (2000, 2500)]
    roots = superminhash.link_roots(spark.createDataFrame(star, "a bigint, b bigint"))
    got = {r.node: r.root for r in roots.collect()}
    assert got == {n: 0 for n in [*range(2001), 2500]} | {3000: 3000, 3001: 3000, 3002: 3000}
