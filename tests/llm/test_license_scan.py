import random

import numpy as np
import pytest

from reconlake.llm.license_scan import MARKS, TEMPLATES, WORD, TemplateIndex, aligned, scan_licenses, winnow

LONG = "GPL-3.0-free-software"


def slow_matches(index, text):
    """Every template against every place of the text, without an index: names that stand somewhere."""
    found = [m.group().lower() for m in WORD.finditer(text)]
    words = np.array([index.number.get(w, -1 if w[0].isdigit() else 0) for w in found], np.int64)
    out = set()
    for t in index.templates:
        for first in range(len(words)):
            # plain edit distance of the template and the words from `first` on; marks can't be edited
            tail = words[first : first + len(t.words) + t.edits].tolist()
            put_in, left_out = (lambda w, of=of: 99 if of[w] else 1 for of in (t.mark_in, index.mark))
            row = [0]
            for w in tail:
                row.append(row[-1] + put_in(w))
            for wanted in t.words.tolist():
                new = [row[0] + left_out(wanted)]
                for j, w in enumerate(tail, 1):
                    new.append(min(row[j - 1] + (0 if w == wanted else max(put_in(w), left_out(wanted))), row[j] + left_out(wanted), new[j - 1] + put_in(w)))
                row = new
                if min(row) > t.edits:
                    break
            if min(row) <= t.edits:
                out.add(t.name)
                break
    return out


def test_a_template_is_found_wherever_it_stands():
    index, rng = TemplateIndex(TEMPLATES), random.Random(11)
    for name, text in TEMPLATES.items():
        before, after = (" ".join(f"qx{rng.randint(0, 99)}" for _ in range(rng.randint(0, 30))) for _ in range(2))
        whole = f"{before} {text.upper()} {after}"
        assert [(m[0], m[1]) for m in index.scan(whole)] == [(name, 1.0)]
        found = index.scan(whole)[0]
        assert whole[found[2] : found[3]].split()[0].strip('"') == text.upper().split()[0]


@pytest.mark.parametrize("seed", range(3))
def test_edited_templates_like_every_place_tried(seed):
    rng = random.Random(seed)
    some = {n: t for n, t in TEMPLATES.items() if len(t.split()) < 60}
    index = TemplateIndex(some)
    hits = 0
    for _ in range(60):
        words = rng.choice(list(some.values())).split()
        for _ in range(rng.randint(0, max(1, len(words) // 4))):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            if kind == 0:
                words[at] = rng.choice(["the", "xx", "2.0", "nc", words[0]])
            elif kind == 1 and len(words) > 1:
                del words[at]
            else:
                words.insert(at, rng.choice(["of", "yy", "4.0", "sa", "the"]))
        text = " ".join(["qq", *words, "zz the license"])
        want = slow_matches(index, text)
        got = {m[0] for m in index.scan(text)}
        assert got <= want and bool(got) == bool(want)
        hits += bool(want)
    assert hits > 10


def test_documents_like_every_place_tried(spark):
    index = TemplateIndex({n: t for n, t in TEMPLATES.items() if len(t.split()) < 9})
    rows = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in rows:
        words = [m.group().lower() for m in WORD.finditer(text)]
        near = " ".join(w for w in words if w in index.number)  # a superset of what can match stays close together
        got = {m[0] for m in index.scan(text)}
        if got or len(near.split()) < 100:
            want = slow_matches(index, text)
            assert got <= want and bool(got) == bool(want)


def test_edits_lower_the_coverage_and_too_many_hide_it():
    index, words = TemplateIndex(TEMPLATES), TEMPLATES["MIT"].split()
    some = [w for i, w in enumerate(words) if i % 10 != 5]
    found = index.scan(" ".join(some))
    assert [m[0] for m in found] == ["MIT"] and 0.8 <= found[0][1] < 1.0
    assert not index.scan(" ".join(words[: len(words) // 2]))


def test_winnowing_keeps_one_of_each_window():
    hashes = np.random.default_rng(12).integers(0, 9, 200).astype(np.uint64)
    chosen = set(winnow(hashes, 4).tolist())
    for i in range(len(hashes) - 3):
        assert any(hashes[j] == hashes[i : i + 4].min() for j in chosen & set(range(i, i + 4)))
    assert winnow(hashes[:0], 4).tolist() == [] and winnow(hashes[:1], 4).tolist() == [0]


def test_banded_alignment_is_the_edit_distance_to_some_span():
    rng = random.Random(13)
    for _ in range(200):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(1, 9))] for _ in range(2))
        best = 99
        for first in range(len(b) + 1):
            row = list(range(len(b) - first + 1))
            for i, x in enumerate(a, 1):
                new = [i]
                for j, y in enumerate(b[first:], 1):
                    new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
                row = new
            best = min(best, *row)
        edits, matched, start, past = aligned(np.array(a), np.array(b), -20, 20)
        assert edits == best and 0 <= start <= past <= len(b) and matched <= min(len(a), past - start) and len(a) - matched <= edits


def test_rows(spark, awkward, empty):
    text = f"x {TEMPLATES['MIT-notice']} y\n{TEMPLATES['MIT-notice']}"
    docs = spark.createDataFrame([(1, text, 0.1), (1, text, 0.2), (None, text, None), (2, None, 0.0), (3, "", 0.0)], "doc_id long, text string, coverage double")
    rows = scan_licenses(docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "1", "1", "None", "None"]
    assert all(text[r.first_char : r.past_char] == TEMPLATES["MIT-notice"][:-1] and r.coverage == 1.0 for r in rows)
    assert scan_licenses(awkward).count() == 0 and scan_licenses(empty).count() == 0


@pytest.mark.parametrize(
    ("notice", "names"),
    [
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-notice"]),
        ("licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0-notice"]),
        ("licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0-notice"]),
        ("Licensed under the Mozilla Public License, version 2.0.", ["MPL-2.0-notice"]),
        ("Licensed under the BSD 3-Clause License.", ["BSD-3-Clause-notice"]),
        ("Copyright qx 2001. All rights reserved.", ["All-rights-reserved-notice"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0-notice"]),
        ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0-notice"]),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0-notice"]),
        ("Licensed under CC BY 3.0.", []),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("Released under this MIT License.", ["MIT-notice"]),
        ("Licensed under the GNU General Public License, version 4.", []),
    ],
)
def test_notices_are_told_apart(notice, names):
    assert [m[0] for m in TemplateIndex(TEMPLATES).scan(f"qx qy\n{notice}\nqz")] == names


def edited(name, old, new):
    assert old in TEMPLATES[name], name
    return TEMPLATES[name].replace(old, new)


def test_versions_and_kinds_are_told_apart_in_long_templates():
    index = TemplateIndex(TEMPLATES)
    long = {n: t for n, t in TEMPLATES.items() if len(t.split()) > 60}
    gpl = [n for n, t in long.items() if "General Public License" in t]
    assert gpl
    for name in gpl:
        text = long[name]
        for old, new in (("version 2", "version 1"), ("version 2", "version 4"), ("version 3", "version 4"), ("General", "Lesser General"), ("General", "Library General"), ("Lesser ", ""), ("Affero ", ""), ("program", "library"), ("library", "program")):
            if old in text:
                other = text.replace(old, new)
                assert other == text or name not in {m[0] for m in index.scan(other)}, (name, old, new)
                assert not {m[0] for m in index.scan(other)} - {n for n, t in TEMPLATES.items() if t in other}, (name, old, new)


def test_words_put_in_lower_the_similarity():
    index = TemplateIndex(TEMPLATES)
    words = TEMPLATES["BSD-3-Clause"].split()
    more = words[: len(words) // 2] + "all advertising materials mentioning features or use of this software must display the following acknowledgement".split() + words[len(words) // 2 :]
    found = [m for m in index.scan(" ".join(more)) if m[0] == "BSD-3-Clause"]
    assert found and found[0][1] == 1.0 and found[0][4] < 0.95
    assert index.scan(TEMPLATES["BSD-3-Clause"])[0][4] == 1.0


def test_a_text_that_ends_inside_a_template():
    assert aligned(np.arange(1, 21), np.arange(1, 17), -4, 4) == (4, 16, 0, 16)
    words = TEMPLATES[LONG].split()
    assert [m[0] for m in TemplateIndex(TEMPLATES).scan(" ".join(words[: len(words) * 17 // 20]))] == [LONG]


def test_license_lines_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()
    rows = scan_licenses(docs).collect()
    got = {(r.doc_id, r.license) for r in rows}
    lines = {
        "GPL-3.0-notice": "licensed under the GNU General Public License, version 3.", "All-rights-reserved-notice": "All rights reserved.", "MIT-notice": "Released under the MIT License.",
        "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    }
    for name, line in lines.items():
        want = {r.doc_id for r in docs.collect() if line in (r.text or "")}
        assert want and want == {d for d, n in got if n == name}
    assert all("CC-BY-4.0-notice" != n for _, n in got)
    assert MARKS
