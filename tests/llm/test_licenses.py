"""Notices that share most of their words are told apart."""

from __future__ import annotations

import pytest

from meterline.llm import licenses

NOTICE = (
    "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public "
    "License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
)


@pytest.mark.parametrize("rows", [[
    (1, "program", "", "3", "GPL-3.0"), (2, "program", "", "2", "GPL-2.0"), (3, "library", "Lesser ", "2.1", "LGPL"),
    (4, "program", "Lesser ", "3", "LGPL"), (5, "program", "Affero ", "3", "AGPL-3.0"), (6, "software", "", "2", "GPL-2.0"),
]])
def test_related_notices(spark, rows):
    docs = spark.createDataFrame([(i, "Before. " + NOTICE.format(*r)) for i, *r, _ in rows], "doc_id long, text string")
    found = licenses.scan_licenses(docs, licenses.license_templates(spark)).collect()
    assert sorted((r["doc_id"], r["license"]) for r in found) == [(r[0], r[-1]) for r in rows]
