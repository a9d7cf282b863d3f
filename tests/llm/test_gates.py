"""The keyword gates of the license scan drop no detection."""

import re

import pytest

pytest.importorskip("peptura.llm")

from peptura.llm.licenses import FAMILIES, SIGNATURES, build_rules, scan_text  # noqa: E402


def test_gates_pass_their_own_names():
    rules = build_rules()
    open_rules = [(label, rx, b"", priority) for label, rx, _, priority in rules]
    texts = [re.sub(r"\.\{.*?\}", "x", re.sub(r"\(\?:([^|)]*)[^)]*\)\??", r"\1", words)) for _, words, _ in SIGNATURES]
    for _, names, versions, _ in FAMILIES:
        for name in names:
            texts += [name, f"licensed under the {name}", f"SPDX-License-Identifier: {name}"]
            texts += [f"{name} version {v} or later; {name} v{v.replace(' ', '')}" for v in versions]
    for t in texts:
        assert scan_text(t, rules) == scan_text(t, open_rules), t
    # each rule of a name is open to a text that is no more than the name
    for _, names, _, _ in FAMILIES:
        for name in names:
            mine = [key for _, rx, key, _ in rules if f"{name}(?:".encode() in rx.pattern or rx.pattern.endswith(f"{name}(?= )".encode())]
            assert len(mine) >= 2 and any(key in b" " + name.encode() + b" " for key in mine)
    assert [x[2] for x in scan_text("Under the GNU Free Documentation License.", rules)[1]] == ["gfdl"]
    assert [x[2] for x in scan_text("GNU Free Documentation License, version 1.3 or later", rules)[1]] == ["gfdl-1.3-or-later"]


def written_out(words):
    """The texts that a signature stands for: every choice of its groups, with and without what may be missing."""
    import itertools

    parts = re.split(r"(\(\?:[^()]*\)\??|\[[^\]]*\]|.\?)", re.sub(r"\.\{.*?\}", "x ", re.sub(r"\)\*", ")?", words)))
    choices = []
    for p in parts:
        if p.startswith("(?:"):
            inner = p[3:].rstrip("?").rstrip(")").split("|")
            choices.append(inner + ([""] if p.endswith("?") else []))
        elif p.startswith("["):
            choices.append([p[1]])
        elif len(p) == 2 and p[1] == "?":
            choices.append([p[0], ""])
        else:
            choices.append([p])
    return ("".join(c) for c in itertools.islice(itertools.product(*choices), 300))


def test_signatures_hold_their_keyword():
    rules = build_rules()
    checked = 0
    for n, (_, words, key) in enumerate(SIGNATURES):
        if re.search(r"\([^()]*\(", words):  # nested groups: see the test above
            continue
        for t in written_out(words):
            norm = f" {' '.join(t.replace('?', '').split())} ".encode()
            if rules[n][1].search(norm):
                checked += 1
                assert key.encode() in norm, (words, key, t)
    assert checked > 300
