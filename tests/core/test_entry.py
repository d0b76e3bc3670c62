import subprocess
import sys
from pathlib import Path

HOME = Path(__file__).resolve().parents[2]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_part(tmp_path):
    """The rest imports where that part and the pipeline are missing."""
    script = "import sys; sys.modules['tapewright.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", script], cwd=HOME, check=True)
