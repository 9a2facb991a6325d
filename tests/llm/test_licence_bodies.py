"""Licences by their own wording, without their title."""

from __future__ import annotations

import re

from tipoff.llm import license_scan

TEXTS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated files",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted.",
    "zlib": "Altered source versions must be plainly marked as such, and must not be\nmisrepresented as being the original software.",
}


def test_bodies_are_found(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id string, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan(df).collect()} == {k: [k] for k in TEXTS}


def test_body_keywords_and_gate_are_in_every_rule():
    for label, rx, key, word, _, _ in license_scan.BODIES:
        assert key in rx and word in rx and re.search(license_scan.GATE, rx), (label, rx)
