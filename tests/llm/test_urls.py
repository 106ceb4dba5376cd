"""URL trees on hosts that their training hasn't seen."""

import zlib

import duckdb
import numpy as np

from lumenlint.llm import urls

CLEAN = ["https://river-walk-society.example.org/spring-meeting-notes-and-maps", "http://old-town-bakery.example.com/menu/summer-cakes", "https://st-anne-school.example.net/search?q=term&lang=en&sort=date"]


def test_clean_hyphens_slugs_and_parameters_pass():
    assert (urls.UrlModel(urls.seed()).score(CLEAN) < 0.5).all()


def test_no_name_of_the_tables_is_in_the_seed():
    name = lambda u: urls.host_of(u).split(".")[-3] if urls.host_of(u).count(".") > 1 else ""
    pages = duckdb.sql("SELECT url FROM '/root/testdata/sf0.1/pages.parquet' WHERE url IS NOT NULL").fetchall()
    hyphens = {name(u) for (u,) in pages if "-" in name(u)}
    assert not hyphens & {name(u) for u, _ in urls.seed()}


def test_hosts_held_out_by_name():
    rows = urls.seed()
    held = [zlib.crc32(".".join(urls.host_of(u).split(".")[-3:-2]).encode()) % 4 == 0 for u, _ in rows]
    model = urls.UrlModel([r for r, h in zip(rows, held) if not h])
    some = [r for r, h in zip(rows, held) if h]
    got, want = model.score([u for u, _ in some]) >= 0.5, np.array([y for _, y in some])
    assert (got == want).mean() > 0.9 and got[want == 0].mean() < 0.05


def test_trees_score_as_one_walks_them():
    """All URLs of a table, each walked down each tree by hand."""
    model = urls.UrlModel(urls.seed(4))
    pages = [u for (u,) in duckdb.sql("SELECT url FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    got = model.score(pages)
    for u, score in zip(pages, got):
        x = urls.features(u, model.suffixes, model.overall, grams=model.grams)
        f = model.trees.base
        for feature, cut, value in model.trees.trees:
            node = 0
            for level in range(model.trees.depth):
                j = feature[level][node]
                node = 2 * node + (sum(e < x[j] for e in model.trees.edges[j]) > cut[level][node])
            f += value[node]
        assert abs(1 / (1 + np.exp(-f)) - score) < 1e-9


def test_well_known_hosts_that_the_seed_does_not_name():
    model = urls.UrlModel(urls.seed())
    clean = ["https://www.python.org/downloads/release/", "https://gitlab.com/inkscape/inkscape/-/blob/master/README.md", "https://www.washingtonpost.com/world/2024/03/01/some-longer-article-title/", "https://fr.wikipedia.org/wiki/Apache", "https://www.bl.uk/", "https://www.cam.ac.uk/research/news/a-long-slug-of-a-story"]
    foul = ["http://best-poker-jackpot.biz/play", "https://online-viagra-meds.xyz/", "http://q8x0vz71kd93jwpt5.top/", "https://payday-loans.click/apply?id=3", "https://pixel.adform.net/imp?cb=123456&r=9876543", "https://freewarezcrack.info/keygen"]
    assert (model.score(clean) < 0.5).all() and (model.score(foul) >= 0.5).sum() >= 5
    assert not {urls.host_of(u) for u in clean + foul} & {urls.host_of(u) for u, _ in urls.seed()}
