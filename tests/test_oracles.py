import oracle_constants
from cohortspark.operators import anchors
from cohortspark.plans import phenotype
from cohortspark.sources import lookups


def test_constants_agree_with_the_package():
    homes = {"CANCER_ICD9": anchors, "CANCER_ICD10": anchors, "SUPPORTIVE_DX": anchors, "LAB_LIMITS": lookups, "VITAL_LIMITS": lookups}
    for name in [n for n in dir(oracle_constants) if n.isupper()]:
        assert getattr(oracle_constants, name) == getattr(homes.get(name, phenotype), name), name
    assert "cohortspark" not in open("oracles.py", encoding="utf-8").read()
