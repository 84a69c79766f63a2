"""Segmentation copies no list of headings at every heading, and finds what a fold over lines finds."""

import random

from lectern.operators import segment

LINES = ["```", "~~~ x", "# One", "# Two", "## A", "## B", "### c", "text", "", "  ", "---"]


def outline(lines):
    open_, title, begun, heads = False, -1, -1, []
    for i, x in enumerate(lines):
        fence, blank = x.startswith(("```", "~~~")), not x.strip()
        head, one = not open_ and x.startswith("## "), not open_ and x.startswith("# ") and title < 0
        if not (head or one or fence or blank) and begun < 0 and not heads:
            begun = i
        title, heads, open_ = (i if one else title), heads + [i] * head, open_ != fence
    return title, begun, heads


def test_outline(spark):
    r = random.Random(2)
    docs = [(i, [r.choice(LINES) for _ in range(r.randrange(14))]) for i in range(2000)]
    found = segment._outlined(spark.createDataFrame(docs, "k int, _lines array<string>"))
    assert {x.k: (x._title, x._begun, x._heads) for x in found.collect()} == {k: outline(x) for k, x in docs}


def test_no_list_grows(spark):
    lectures = spark.createDataFrame([("a", 1, "a.md", "# T\n## A\nx")], "lecture_id string, lecture_order int, file_name string, text string")
    plan = segment.segment(lectures)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "lambdafunction(get(concat" not in plan
