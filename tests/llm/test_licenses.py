"""Licence names and versions, full texts, wrapped notices, and a scan by brute force."""

import random
import textwrap

import pytest

from sparkloom.llm import licenses


def names(text):
    return [f[2] for f in licenses.find(text, licenses.TEMPLATES)]


@pytest.mark.parametrize("text,want", [
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("Licensed under the Apache License, Version 1.1.", []),
    ("Licensed under CC BY 3.0.", ["CC-BY-3.0"]),
    ("Licensed under CC-BY-NC-ND-4.0.", ["CC-BY-NC-ND-4.0"]),
    ("This work is licensed under a Creative Commons Attribution 3.0 International License.", ["CC-BY-3.0-work"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0-work"]),
    ("This work is licensed under the GNU General Public License, version 1.", ["GPL-1.0"]),
    ("This work is licensed under the GNU General Public License, version 4.", []),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
    ("This work is licensed under the GNU Affero General Public License, v3.0.", ["AGPL-3.0"]),
    ("Released under the BSD License.", []),
])
def test_names_and_versions_agree(text, want):
    assert names(text) == want
    assert names(f"Some prose, on another matter.\n\n{text} More of it.") == want


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_is_found_as_itself(name):
    text = licenses.TEMPLATES[name]
    for width in (40, 72, 10_000):
        wrapped = "x y z\n\n" + textwrap.fill(text, width, break_on_hyphens=False, break_long_words=False) + "\n\nand so on"
        ((start, end, found, reduction, missing, added),) = licenses.find(wrapped, licenses.TEMPLATES)
        assert found == name and not missing and not added and reduction >= licenses.LEAST_REDUCTION
        assert wrapped[start:end].split() == text.split()


def test_candidates_by_brute_force():
    rng = random.Random(6)
    templates = {"one": "alpha beta gamma delta epsilon zeta eta license", "two": "license alpha theta beta kappa 2.0", "three": "iota license kappa lambda mu nu xi omicron pi rho sigma tau"}
    worded = licenses._worded(tuple(sorted(templates.items())))
    for _ in range(150):
        block = []
        while len(block) < 25:
            t = list(worded[rng.choice(list(worded))][0])
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(["x", "y", "license"])
            block += t[: rng.randint(1, len(t))]
        got = {name: [c for c in licenses.candidates(block, worded) if c[2] == name] for name in templates}
        for name, (template, _, most, tells) in worded.items():
            best = None
            for i in range(len(block)):
                for j in range(i + 1, len(block) + 1):
                    missing, added = licenses.differences(template, block[i:j])
                    differ, kept = len(missing) + len(added), len(template) - len(missing)
                    if differ <= most and kept > 0 and tells <= set(block):
                        best = max(best or (-99,), (kept - differ,))
            assert (max(c[0] for c in got[name]) if got[name] else None) == (best and best[0])
            for score, differ, _, first, end in got[name]:
                missing, added = licenses.differences(template, block[first:end])
                assert (differ, score) == (len(missing) + len(added), len(template) - len(missing) - differ)


def test_equal_savings_go_to_the_first_name():
    two = {"b": "one two three license", "a": "one two three license"}
    assert [f[2] for f in licenses.find("one two three license\n" * 2, two)] == ["a", "a"]
