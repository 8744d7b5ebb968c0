from pyspark.sql import functions as F

from pagelattice.functions import geometry
from pagelattice.operators import capture_rules as rules

BOX = "struct<x:double,y:double,width:double,height:double>"


def test_edges():
    assert rules.edges({}) == {"segment": 1568, "target": 1568, "crop": 800}
    assert rules.edges({"LONG_EDGE": "99999", "CROP_MAX_EDGE": "x"}, {"segment": 10}) == {"segment": 256, "target": 4096, "crop": 800}


def test_visibility(spark):
    box = (10.0, 10.0, 50.0, 20.0)
    nodes = spark.createDataFrame([(1, n, (*box[:1], -30.0, *box[2:]) if n == 4 else box) for n in range(6)], f"page_id int, node int, box {BOX}")
    pages = spark.createDataFrame([(1, 1000, 2000)], "page_id int, width int, height int")
    itself = [(1, n, True, "none" if n == 1 else "block", "visible", 0.01 if n == 2 else None, False, box, n == 5) for n in range(6)]
    parent = [(1, 3, False, "block", "visible", 1.0, True, (0.0, 0.0, 100.0, 5.0), False), (1, 0, False, "block", "visible", 1.0, True, (0.0, 0.0, 100.0, 50.0), False)]
    schema = f"page_id int, node int, itself boolean, display string, visibility string, opacity double, clips boolean, box {BOX}, closed_details boolean"
    found = rules.visible_nodes(nodes, spark.createDataFrame(itself + parent, schema), pages)
    assert [r.node for r in found.collect()] == [0]


def test_prompt_and_manifest(spark):
    b = lambda *v: geometry.box(*[F.lit(float(x)) for x in v])
    none = F.array().cast("array<struct<iter:int>>")
    said = spark.range(1).select(rules.match_prompt("Find it.", b(0, 100, 50, 100), F.lit(100), F.lit(1000), F.lit(1000), none)).first()[0]
    assert said.startswith("Find it.") and "15.0%" in said and "Already" not in said
    control = "array<struct<role:string,bbox:" + BOX + ">>"
    schema = f"pair_id int, iter int, label string, rect {BOX}, remainder_top double, width double, height double, expandable boolean, kind string, controls {control}, passes int"
    rows = [(1, 1, "tabs", (0.0, 0.0, 50.0, 100.0), 100.0, 100.0, 1000.0, True, None, [(None, (0.5, 0.5, 0.5, 0.5)), ("x", None)], None), (1, 2, "y", None, 0.0, 1.0, 1.0, False, None, None, None)]
    (found,) = rules.manifest(spark.createDataFrame(rows, schema)).collect()
    assert (found.kind, found.suggested_passes, len(found.controls), found.controls[0].role) == ("unknown", 4, 1, "other")
    assert tuple(found.controls[0].bbox) == (0.25, 0.1 + 0.05, 0.25, 0.05)
