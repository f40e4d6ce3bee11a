"""The core library and its tests never name the training-data subpackage."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_core_does_not_import_the_training_data_subpackage():
    files = [p for top in ("callrank", "tests", "tools") for p in (ROOT / top).rglob("*.py")]
    files = [p for p in [*files, ROOT / "bench.py"] if "llm" not in p.relative_to(ROOT).parts[:-1]
             and p.name != pathlib.Path(__file__).name]
    named = [str(p) for p in files if re.search(r"callrank\.llm|callrank import llm|corpus_pipeline", p.read_text())]
    assert len(files) > 20 and not named
