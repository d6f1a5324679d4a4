import textwrap

import numpy as np
import pytest

from panelrisk.llm import licenses


@pytest.fixture(scope="module")
def model():
    return licenses.fit(["The cat sat on the mat and looked at the licence.", "All the people reserved their rights to the work."])


@pytest.mark.parametrize(("line", "family"), [
    ("Released under the MIT License.", "MIT"), ("  released UNDER the mit license  ", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA"), ("Licensed under CC BY 4.0.", "CC-BY"), ("Copyright 2020 Jane. All rights reserved.", "proprietary"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "MIT"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "BSD"),
])
def test_families(model, line, family):
    assert [f[0] for f in licenses.scan([f"intro\n{line}\nend"], model)[0]] == [family]


@pytest.mark.parametrize("line", ["Licensed under the Foo Bar License 9.1", "He was released under the bridge.", "the of and to", "", "All the rights of man were reserved for few.", "A version 3 of the general public plan"])
def test_unknown(model, line):
    assert licenses.scan([line], model) == [[]]


def test_offsets_are_those_of_the_whole_text(model):
    text = "Ünder\n\n  Released under the MIT License.\t\nx"
    (family, paragraph, start, end, probability, template), = licenses.scan([text], model)[0]
    assert (family, paragraph, text[start:end]) == ("MIT", 2, "Released under the MIT License.") and probability > 0.6 and template == 1.0


def test_table_has_every_planted_line(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scanned, name = licenses.with_licenses(docs, licenses.train(docs))
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "All rights reserved.": "proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for row in scanned.collect():
        assert [x.family for x in row[name]] == [lines[line] for line in row.text.split("\n") if line in lines]


def test_odd_rows(spark, odd_docs, no_docs):
    scanned, name = licenses.with_licenses(odd_docs, licenses.train(odd_docs))
    assert name == "licenses_" and scanned.count() == odd_docs.count() and all(r[name] == [] for r in scanned.collect())
    assert licenses.with_licenses(no_docs, licenses.train(no_docs))[0].count() == 0


MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."
)
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version."
)
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"


@pytest.mark.parametrize("width", [40, 72, 80])
@pytest.mark.parametrize("mark", ["", "# ", " * "])
@pytest.mark.parametrize(("notice", "family"), [(MIT, "MIT"), (BSD, "BSD"), (GPL, "GPL-3.0"), (APACHE, "Apache-2.0")])
def test_wrapped_notices(model, notice, family, mark, width):
    lines = textwrap.wrap(notice, width)
    text = "\n".join(["Ünder", "", "the first line of the program", *(mark + line for line in lines), "and the next of it", "", "end"])
    (found, paragraph, start, end, probability, template), = licenses.scan([text], model)[0]
    assert found == family and 2 <= paragraph <= 3 and probability >= licenses.LEAST_PROBABILITY and template >= licenses.LEAST_TEMPLATE
    assert text[start:end].startswith((mark.strip() + " " + lines[0]).strip() if paragraph == 3 else "the first") and end <= text.index("\n\nend")


def test_notices_of_one_block(model):
    text = "\n".join([*textwrap.wrap(MIT, 60), *textwrap.wrap(BSD, 60), "Licensed under CC BY-NC 4.0.", *textwrap.wrap(MIT, 75)])
    assert [f[0] for f in licenses.scan([text], model)[0]] == ["MIT", "BSD", "CC-BY-NC", "MIT"]
    assert licenses.scan([BSD[:60] + "\n\n" + BSD[60:]], model) == [[]]


def standard(name, subject="program", mark=":", version="3"):
    return f"This {subject} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


@pytest.mark.parametrize(("notice", "family"), [
    (standard("Affero General Public License"), "AGPL"), (standard("Lesser General Public License"), "LGPL"), (standard("Lesser General Public License", "library", ";", "2.1"), "LGPL"),
    (standard("General Public License"), "GPL-3.0"), (standard("General Public License", mark=";", version="2"), "GPL-2.0"), ("SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL"),
    ("Released under the GNU Affero General Public License.", "AGPL"), ("Licensed under the Mozilla Public License 2.0.", "MPL-2.0"),
])
@pytest.mark.parametrize("width", [10_000, 70])
def test_families_that_differ_by_a_word(model, notice, family, width):
    assert [f[0] for f in licenses.scan(["\n".join(["x", "", *textwrap.wrap(notice, width), "", "y"])], model)[0]] == [family]


@pytest.mark.parametrize("notice", [
    "Licensed under the Eclipse Public License 2.0.", "Licensed under the Nokia Public License 2.0.", "Licensed under the Acme License, Version 2.0.", "Licensed under CC BY-ND 4.0.", "Released under the Sleepycat License.",
    "This work is licensed under the GNU Free Documentation License, version 3.", standard("Free Documentation License"), standard("General Public License", version="7"), "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: OFL-1.1",
    "Licensed under the Eiffel Forum License, version 2.", "Released under the Vim License.",
])
def test_foreign_licences_are_unknown(model, notice):
    assert licenses.scan([notice], model) == [[]]


@pytest.mark.parametrize(("line", "found"), [
    ("# SPDX-License-Identifier: Apache-2.0 OR MIT", [("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"), ("MIT", "MIT")]),
    ("SPDX-License-Identifier: (MPL-2.0 OR EPL-2.0) AND CC-BY-4.0", [("MPL-2.0", "SPDX-License-Identifier: (MPL-2.0"), ("CC-BY", "CC-BY-4.0")]), ("SPDX-License-Identifier: OR", []),
])
def test_spdx_expressions(model, line, found):
    assert [(f[0], line[f[2] : f[3]]) for f in licenses.scan([line], model)[0]] == found


def test_probabilities_are_calibrated_on_kept_notices(model):
    """Notices changed in ways that training doesn't know: words swapped for others; families and foreign licences."""
    import random

    rng, likely, right = random.Random(3), [], []
    notices = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts] + [(licenses.UNKNOWN, t) for t in licenses.FOREIGN]
    for family, text in notices * 12:
        words = text.split()
        for _ in range(max(1, len(words) // 10)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["kindly", "hereby", "software", "our", "project"]))
        p = model.probabilities(licenses.grams([" ".join(words)])[1])[0]
        likely.append(p.max())
        right.append(licenses.FAMILIES[p.argmax()] == family)
    likely, right = np.array(likely), np.array(right)
    assert right.mean() > 0.9 and abs(likely.mean() - right.mean()) < 0.1
    sure = likely > 0.9
    assert sure.mean() > 0.3 and right[sure].mean() > 0.95


def test_table_against_a_scan_of_templates(spark, sf_dir):
    """Each line of the table that holds all words of a template in order is reported, and no other line."""
    import re

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scanned, name = licenses.with_licenses(docs, licenses.train(docs))
    spoken = {family: [" " + " ".join(re.findall(r"\w+", t.lower())) + " " for t in ts] for family, ts in licenses.TEMPLATES.items()}
    some = 0
    for row in scanned.collect():
        lines = [" " + " ".join(re.findall(r"\w+", line.lower())) + " " for line in (row.text or "").split("\n")]
        expected = [(n, family) for n, line in enumerate(lines) for family, ts in spoken.items() if any(t in line for t in ts)]
        assert [(x.paragraph, x.family) for x in row[name]] == expected
        some += len(expected)
    assert some
