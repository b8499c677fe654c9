"""Letters of every plane."""

from llm import language


def test_letters_beyond_plane_two():
    for text in ("\U00030000\U00030001", "a", "\U00020000"):
        assert len(language.grams(text)[0])
    profiles = language.Profiles({"zh": language.ranked(*language.grams("\U00030000\U00030001\U00030002"), 400)})
    assert profiles.predict("\U00030000\U00030001")[0] == "zh"
    assert language.grams("12 \U0001f600")[0].size == 0
