from pagewright.config import Settings, pages_at_once, retention_days


def test_pages_at_once():
    assert [pages_at_once(m, c) for m, c in ((0.75, 8), (1.75, 8), (4, 8), (64, 8), (2.5, 1))] == [1, 1, 4, 8, 1]


def test_retention_days():
    assert [retention_days(v, 30) for v in (None, "", "7", "0.5", "2.4", "-3", "x", "inf")] == [30, 30, 7, 1, 2, 0, 30, 30]


def test_text_limit_is_the_references():
    assert Settings().metadata_max_chars == 24_000
