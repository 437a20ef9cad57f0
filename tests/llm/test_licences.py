from __future__ import annotations

import textwrap

from chargeframe.llm import licences


def test_wrapped_notices(spark):
    """Each long notice, wrapped at several widths within other lines."""
    rows, want = [], []
    for family, notices in licences.TEMPLATES.items():
        for notice in notices:
            for width in (30, 50, 72, 78):
                wrapped = textwrap.wrap(notice, width)
                if len(wrapped) > 1 and len(notice) > 100:
                    rows.append((len(rows), "\n".join(["Some words about the weather", "", *wrapped, "", "and more of them"])))
                    want.append((len(rows) - 1, 2, family, True))
    two = textwrap.wrap(licences.TEMPLATES["mit"][2], 72) + [""] + textwrap.wrap(licences.TEMPLATES["apache-2.0"][1], 72)
    rows.append((1000, "\n".join(two)))
    want += [(1000, 0, "mit", True), (1000, two.index("") + 1, "apache-2.0", True)]
    rows.append((1001, "# All rights reserved.\n# All rights reserved.\n\nnothing here"))
    want += [(1001, 0, "proprietary", True), (1001, 1, "proprietary", True)]
    got = [tuple(r)[:3] + (r["confirmed"],) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(want)
