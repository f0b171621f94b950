"""Media of large and deep JSON: none is left out."""

import json

import pytest

from lodestrata.functions import jsontree
from lodestrata.plans import catalogue, standins


def _url(name) -> str:
    return f"https://h.com/{name}.jpg"


def _deep(value, depth: int, key: str = "a"):
    for _ in range(depth):
        value = {key: value}
    return value


LONG = {"image": [_url(f"l{i}") for i in range(450)]}
DEEP = {"image": _deep([[[_url("d40")]], _url("d38")], 38), "last": _url("last")}
#: Commerce keys only beyond what a score counts: behind many items, below many levels, after many keys.
HIDDEN = [
    [{"x": 1}] * 60 + [{"image": _url("h0")}],
    _deep({"image": _url("h1")}, 12),
    [_deep(0, 1, "k0"), {f"k{i}": 0 for i in range(3000)}, {"image": _url("h2")}],
]


def _pages() -> dict[str, tuple[str, list[str]]]:
    """Pages by id, with the names of all media in them in the order in which they count."""
    long, deep = [f"l{i}" for i in range(450)], ["d40", "d38", "last"]
    script = lambda tree, kind: f"<script type='application/{kind}'>{json.dumps(tree)}{' ' * 200}</script>"
    scored = script({"sku": 1, "media": _url("scored")}, "json")
    return {
        "ld_long": (script(LONG, "ld+json"), long),
        "ld_deep": (script(DEEP, "ld+json"), deep),
        "blob_long": (script(LONG, "json"), long),
        "blob_deep": (script(DEEP, "json"), deep),
        "hidden": ("".join(script(t, "json") for t in HIDDEN) + scored, ["scored", "h0", "h1", "h2"]),
        "no_commerce": (script([{"x": 1}] * 60 + [{"note": _url("n")}], "json"), []),
    }


def test_all_of_a_tree_is_walked():
    found = list(jsontree.walk_urls([LONG, DEEP]))
    assert [u for u, _, _ in found] == [*LONG["image"], _url("d40"), _url("d38"), _url("last")]
    assert {(k, p) for _, k, p in found} == {("image", ".image"), ("image", ".image" + ".a" * 38), ("image", ".last")}
    assert [u for u, _, _ in jsontree.walk_urls(_deep(_url("x"), 3000))] == [_url("x")]


def test_html_evidence_counts_all_media(spark, tmp_path):
    pages = _pages()
    spark.createDataFrame([(k, "https://h.com", h) for k, (h, _) in pages.items()], "page_id string, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.n_media for r in catalogue.html_evidence(spark, str(tmp_path)).collect()} == {k: len(n) for k, (_, n) in pages.items()}


@pytest.fixture
def whole_pages(spark, monkeypatch):
    pages = _pages()
    monkeypatch.setattr(standins, "rich_pages", lambda spark, sf_dir: spark.createDataFrame([(k, h) for k, (h, _) in pages.items()], "page_id string, html string"))
    return pages


def test_page_media_has_all_media(spark, whole_pages):
    rows = catalogue.page_media(spark, "").orderBy("page", "place").collect()
    for page, (_, names) in whole_pages.items():
        assert [(r.url, r.place) for r in rows if r.page == page] == [(_url(n), i) for i, n in enumerate(names)]
    assert {r.path_hint for r in rows if r.page in ("ld_long", "blob_long")} == {".image"}
