import os
import re
import subprocess
import sys

import __spark_entry__ as E

ROOT = os.path.dirname(os.path.abspath(E.__file__))


def test_registry():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60


def test_only_the_subpackage_knows_itself():
    for folder, _, names in os.walk(os.path.join(ROOT, "metaquarry")):
        if not folder.endswith("llm"):
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(os.path.join(folder, n)).read()), n


def test_the_rest_works_without_it():
    code = "import sys; sys.modules['metaquarry.llm'] = None\nimport __spark_entry__ as e\nassert 'p1_found' in e.queries() and 'p8_ids' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
