from loomline.llm import toxicity


def test_hash_space_and_bounds():
    assert toxicity.SPACE == 1 << 22 and (toxicity.POSITIVES, toxicity.CLEAN, toxicity.UNLABELLED) == (3000, 6000, 6000)
