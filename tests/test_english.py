import pytest

from lodestone.functions import english


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("consist", "consist"), ("consisted", "consist"), ("consistency", "consist"), ("consistently", "consist"), ("consolation", "consol"), ("consolidating", "consolid"),
        ("conspicuously", "conspicu"), ("conspiracies", "conspiraci"), ("constables", "constabl"), ("constancy", "constanc"), ("knackeries", "knackeri"), ("knaves", "knave"),
        ("knees", "knee"), ("knitting", "knit"), ("knives", "knive"), ("knocked", "knock"), ("happy", "happi"), ("flies", "fli"), ("ties", "tie"), ("dying", "die"),
        ("running", "run"), ("hopping", "hop"), ("hoping", "hope"), ("skies", "sky"), ("generously", "generous"), ("general", "general"), ("relational", "relat"),
        ("conditional", "condit"), ("rational", "ration"), ("electricity", "electr"), ("hopefulness", "hope"), ("say", "say"), ("by", "by"), ("cry", "cri"), ("gas", "gas"),
        ("this", "this"), ("kiwis", "kiwi"), ("communism", "communism"), ("succeeding", "succeed"), ("news", "news"), ("adoption", "adopt"), ("replacement", "replac"), ("controlling", "control"),
    ],
)
def test_published_stems(word, want):
    assert english.stem(word) == want


def test_analyse():
    assert english.analyse("The restarting of the Pods' restarts, 3 times!") == ["restart", "pod", "restart", "3", "time"]
    assert english.analyse("") == [] and len(english.STOP_WORDS) == 127
