"""Linear work on adverse texts, letters by category, and workers that lack the package."""

import os
import random
import re
import subprocess
import sys
import unicodedata

import pytest

from flowlake.llm import langid, secrets

MEGABYTE = 1_000_000
ADVERSE = {
    "web_token": "eyJaaaaaaaa" * 90_000 + ".eyJaaaaaaaa.x",
    "web_token parts": "eyJaaaaaaaa.eyJaaaaaaaa." * 40_000 + "x",
    "assign": "password" * 125_000,
    "assign blanks": "secret" + " " * 900 + "token= " * 130_000,
    "access": "AKIA" * 250_000,
    "hex": "0123456789abcde " * 62_500,
    "key_block": "-----BEGIN RSA PRIVATE KEY-----" * 32_000,
    "key_block bodies": ("-----BEGIN PRIVATE KEY-----\n" + "A" * 30 + "\n") * 17_000,
    "key_block open": "-----BEGIN " * 90_000,
    "hub_token": ("ghp_" + "a" * 35 + " ") * 25_000,
    "hub_token run": "ghp_" * 250_000,
    "chat_token": "xoxb-123456789 " * 66_000,
    "chat_token run": "xoxb-" * 200_000,
}


@pytest.mark.parametrize("name", ADVERSE)
def test_scan_work_is_linear(name):
    scanner, text = secrets.Scanner(), ADVERSE[name]
    assert len(text) > 0.85 * MEGABYTE
    scanner.spans(text)
    assert scanner.steps < 4 * len(text)


def test_remembered_runs_change_no_span():
    """Against scanning each start to its end."""

    class Plain(secrets.Scanner):
        def longest(self, rule, data, start, known):
            return super().longest(rule, data, start, {})

    rng, quick, plain = random.Random(9), secrets.Scanner(), Plain()
    parts = ["eyJaaaaaaaa", ".eyJbbbbbbbb", ".cccccccc", "eyJ", ".", "-----BEGIN RSA PRIVATE KEY-----", "-----END PRIVATE KEY-----", "A" * 20, "\n", "ghp_", "a" * 36, "xoxb-", "1234567890", " ", "token=", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        assert quick.spans(text) == plain.spans(text), text


def test_only_letters_make_words():
    odd = "½ ² ① Ⅷ ↀ ௧ ٣ 12 x²y ⅔z ẞ ʰ ǅ ª 一 _a_ n°5"
    want, word = [], ""
    for c in odd.lower() + " ":
        if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo"):
            word += c
        else:
            want, word = want + [word] * bool(word), ""
    assert langid.words_in(odd) == want
    assert langid.words_in("½ ² ① 12") == [] and not re.search(r"[½²①Ⅷ]", "".join(langid.words_in(odd)))


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from flowlake.llm import crosstok, langid, lm, pieces, secrets
docs = spark.createDataFrame([(i, f"the token = abcdef0123456789ab number {{i}} of text", "en") for i in range(20)], "doc_id bigint, text string, lang string")
lacking = docs.select("doc_id").mapInPandas(lambda parts: (p.assign(found=__import__("importlib.util").util.find_spec("flowlake") is not None) for p in parts), "doc_id bigint, found boolean")
assert lacking.where("found").count() == 0
assert langid.fit_predict(docs, F.lit(True)).where("lang_pred = 'en'").count() == 20
assert secrets.digest(docs).where("n_assign = 1").count() == 20
assert pieces.pieces_of(spark, docs).where("round_trip").count() == 20
assert lm.score(docs, lm.fit(docs, F.col("doc_id") % 5 == 0)).count() == 20
assert crosstok.align(docs).where("n_groups > 0").count() == 20
print("all rows")
"""


def test_workers_need_not_have_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "job.py").write_text(SCRIPT.format(root=root))
    done = subprocess.run([sys.executable, "job.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert done.returncode == 0 and "all rows" in done.stdout, done.stderr[-3000:]
