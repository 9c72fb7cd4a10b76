"""Image rules on pages that the derived views do not have."""

import base64

import pytest

from plumbline.functions import scanner
from plumbline.operators import images
from plumbline.plans import catalog

SEGMENT = b"\xff\xe0\x00\x04ab"


def frame(marker, w, h):
    return b"\xff" + bytes([marker]) + b"\x00\x0b\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x01\x01\x11\x00"


def uri(kind, data):
    return f"data:image/{kind};base64,{base64.b64encode(data).decode()}"


def test_jpeg(spark):
    payloads = [
        b"\xff\xd8" + SEGMENT + frame(0xC0, 640, 480),
        b"\xff\xd8" + b"\xff\xe1" + (60_002).to_bytes(2, "big") + b"\xff\xc0" * 30_000 + b"\xff\xff" + frame(0xC2, 150, 70),
        b"\xff\xd8" + SEGMENT,
        b"\xff\xd8" + frame(0xC1, 0, 9),
        b"not an image",
        bytes.fromhex("4749463839612C01C800"),
    ]
    html = "".join(f'<img src="{uri("jpeg", p)}" alt="a{k}">' for k, p in enumerate(payloads)) + '<img src="x.jpg">'
    found = images.extract(spark.createDataFrame([(1, html), (2, None)], "id long, html string"), "id", "html")
    got = [(r["idx"], r["kind"], r["w"], r["h"]) for r in found.orderBy("idx").collect()]
    assert got == [(0, "jpeg", 640, 480), (1, "jpeg", 150, 70), (2, "jpeg", 0, 0), (3, "jpeg", 0, 9), (4, "?", 0, 0), (5, "gif", 300, 200), (6, None, None, None)]
    assert {r["idx"] for r in images.broken(found, "id").collect()} == {2, 3, 4}


@pytest.mark.parametrize(
    "alt,before,after,want",
    [
        ("公式 13", "", "", ("eq", 13, "alt", "zh_eq", None, None, False)),
        ("式（3）式(4)", "", "", ("eq", 4, "alt", "zh_eq", None, None, False)),
        ("assets/eq_12.png", "", "", ("eq", 12, "alt", "asset_eq", None, None, False)),
        ("表：2", "", "", ("tab", 2, "alt", "zh_tab", None, None, False)),
        ("tab_3 and fig 1", "", "", ("tab", 3, "alt", "asset_tab", None, None, False)),
        ("fig-5", "", "", ("fig", 5, "alt", "asset_fig", None, None, False)),
        ("图 1 图 2：x", "", "", ("fig", 2, "alt", "zh_fig", None, None, False)),
        ("图 3", "", "图 3：示例", ("fig", 3, "alt", "zh_fig_bare", "fig", 3, False)),
        ("图 3", "", "图 4：示例", ("fig", 3, "alt", "zh_fig_bare", "fig", 4, True)),
        ("公式 3", "图 3：示例", "", ("eq", 3, "alt", "zh_eq", "fig", 3, True)),
        ("", "", " 图 3：见公式 2", ("fig", 3, "ctx_after", "zh_fig", "fig", 3, False)),
        ("plain", "图 9：x", "如公式 2 与图 3：", ("eq", 2, "ctx_after", "zh_eq", "eq", 2, False)),
        ("remote", "图 1：a 图 2：b", "text", ("fig", 1, "ctx_before", "zh_fig", "fig", 1, False)),
        ("remote", "图 1：" + "x" * 200, "y" * 140 + "图 5：", (None, None, "none", None, None, None, False)),
        ("remote", "图 1 公式 2", "", (None, None, "none", None, None, None, False)),
        ("", "", "", (None, None, "none", None, None, None, False)),
    ],
)
def test_declared(alt, before, after, want):
    assert scanner.declared(alt, before, after) == want


def test_identities(spark):
    html = '<p>图 7：</p><img src="a"><body class="b"><script>"<img alt=\'x\'>"</script><STYLE>图 8：</STYLE><img alt="图 1"><p>图&nbsp;<b>2</b>：x</p><img><p>t</p>'
    got = scanner.image_identities(spark.createDataFrame([(1, html), (2, None), (3, "<p>图 1：</p>")], "id long, html string"), "id", "html").collect()
    assert [tuple(r) for r in got] == [(1, 0, "图 1", "fig", 1, "alt", "zh_fig_bare", "fig", 2, True), (1, 1, "", "fig", 2, "ctx_before", "zh_fig", "fig", 2, False)]


def test_identity_of_derived_pages(spark, sf):
    found = catalog.QUERIES["declared_identity"](spark, sf).collect()
    remote = [r for r in found if r["alt"] == "remote"]
    assert {(r["page_id"] % 4 == 2, r["declared_kind"], r["declared_src"]) for r in remote} == {(True, "fig", "ctx_after"), (False, "fig", "ctx_before")}
    swapped = {r["page_id"] for r in found if r["alt"] == "图 1" and r["label_conflict"]}
    assert swapped == {r["page_id"] for r in found if r["page_id"] % 7 == 2} != set()
    labels = {(r["page_id"], r["idx"]): (r["declared_kind"], r["declared_num"]) for r in catalog.QUERIES["image_identity"](spark, sf).collect()}
    assert labels.keys() == {(r["page_id"], r["idx"]) for r in found}
