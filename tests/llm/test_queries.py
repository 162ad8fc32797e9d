import re
from pathlib import Path

from crawlgauge.llm.queries import ORACLE, QUERIES

# Where each query without SQL is compared with a plain version, an exact round trip or labels.
TESTED_IN = {
    "op1_backoff_automaton": "test_joins.py",
    "op2_weak_labels": "test_text_operators.py",
    "op3_decision_list": "test_text_operators.py",
    "op4_byte_bpe": "test_text_operators.py",
    "op5_text_density": "test_text_operators.py",
    "op7_token_groups": "test_joins.py",
    "op8_virtual_slots": "test_joins.py",
    "op9_pii_crf": "test_text_operators.py",
    "op10_ranked_varbytes": "test_text_operators.py",
    "op11_diagonal_runs": "test_alignment.py",
    "op13_swap_packing": "test_packing.py",
}
MODULES = {
    "op1": "lm", "op2": "weak_labels", "op3": "decision_list", "op4": "bpe", "op5": "html_density", "op7": "jaccard_join",
    "op8": "sharding", "op9": "pii_crf", "op10": "token_files", "op11": "alignment", "op13": "packing",
}


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) == set(ORACLE) | set(TESTED_IN) and not set(ORACLE) & set(TESTED_IN)
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    for name, file in TESTED_IN.items():
        text = (Path(__file__).parent / file).read_text()
        assert MODULES[name.split("_")[0]] + "." in text, name
