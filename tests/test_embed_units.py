"""The units of a page hold every character of its sections."""

from folioscope.operators.search import embed_units


def test_units_hold_the_whole_body(spark):
    intro, long = "i" * 3000, "".join(chr(97 + i % 26) for i in range(7100))
    pages = spark.createDataFrame([(1, "T", f"{intro}\n## {long}\n## end"), (2, "U", ""), (3, "V", None)], "page_id long, title string, body string")
    got = {}
    for r in sorted(embed_units(pages).collect()):
        got.setdefault(r["page_id"], []).append(r["text"])
    assert [len(x) for x in got[1]] == [3002, 3002, 3002, 1105, 8] and "".join(x[2:] for x in got[1]) == intro + "## " + long + "## end"
    assert got[2] == ["U"] and got[3] == ["V"]
    assert [len(r["text"]) for r in sorted(embed_units(pages, most=1).collect()) if r["page_id"] == 1] == [3002, 3002, 8]
