import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def small(spark, monkeypatch):
    from tessera.llm import common

    common.ship(spark)
    monkeypatch.setattr(common, "PAUSES", ())  # there is little to let go of here


def prose(seed: int, n: int) -> list[str]:
    import random

    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n)]
