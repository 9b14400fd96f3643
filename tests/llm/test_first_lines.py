"""Classes' first lines come out of texts that travel once."""

import re

from loomsketch.llm import fuzzy_lines


def test_whole_texts_are_not_grouped(spark):
    rows = [(None, "one line here\n\nand another one"), (1, "a third line"), (1, "a third line"), (2, None), (3, "a fourth\nA THIRD line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, classes = fuzzy_lines.line_classes(docs)
    texts = fuzzy_lines._texts(docs, classes.select("id"), classes)
    found = [r.text for r in texts.collect()]
    assert sorted(found) == ["a fourth", "a third line", "and another one", "one line here"]
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert "first(line#" in plan and not re.search(r"first\(text#", plan)
