"""What may import what, and that nobody looks into another object's insides."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1] / "tidemark"
FEATURES = ("operators/grid.py", "operators/pit.py", "operators/sides.py", "operators/store.py")
TRUTH = {"person_truth", "event_labels", "ground_truth_networks", "network_members"}
GATEWAY = {"_jvm", "_jsc", "_gateway"}  # the way to the JVM


def trees():
    return {str(p.relative_to(ROOT)): ast.parse(p.read_text(encoding="utf-8")) for p in sorted(ROOT.rglob("*.py"))}


def imported(tree):
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield node.module or ""


def test_features_know_nothing_of_the_truth():
    found = trees()
    for name in FEATURES:
        assert not [m for m in imported(found[name]) if m.startswith(("tidemark.operators.truth", "tidemark.synth", "tidemark.operators.checks"))], name
        named = {n.value for n in ast.walk(found[name]) if isinstance(n, ast.Constant) and isinstance(n.value, str)}
        assert not named & TRUTH, name


def test_nothing_but_the_subpackage_imports_llm():
    assert not [name for name, tree in trees().items() if not name.startswith("llm/") and any(m.startswith("tidemark.llm") for m in imported(tree))]


def test_private_attributes_stay_private():
    """`x._name` only on self and cls; a view, which belongs to its store, may look into that."""
    for name, tree in trees().items():
        for node in ast.walk(tree):
            if isinstance(node, ast.Attribute) and node.attr.startswith("_") and not node.attr.startswith("__") and node.attr not in GATEWAY:
                owner = node.value
                own = isinstance(owner, ast.Name) and owner.id in ("self", "cls")
                view = name == "operators/store.py" and isinstance(owner, ast.Attribute) and owner.attr == "_store"
                assert own or view, f"{name}:{node.lineno} {node.attr}"
