import json

import pytest

from tidepanel import config


def test_settings_come_from_a_file_near_or_above(tmp_path):
    (tmp_path / "panel.toml").write_text('[target]\nthreshold = 0.2\n[target.by_category]\ncat_1 = 0.3\n[features]\nreturns = [1, 7]\n[paths]\nraw = "data/raw"\n')
    (tmp_path / "a" / "b").mkdir(parents=True)
    s = config.load(config.find(tmp_path / "a" / "b", "panel.toml"))
    assert s.target == config.Target(threshold=0.2, by_category={"cat_1": 0.3}) and s.features.returns == (1, 7) and s.cleaning == config.Cleaning()
    assert s.paths == {"raw": tmp_path.resolve() / "data/raw"}
    with pytest.raises(FileNotFoundError):
        config.find(tmp_path, "other.toml")


@pytest.mark.parametrize("raw", [{"targets": {}}, {"target": {"treshold": 0.2}}])
def test_misspelt_settings_are_errors(tmp_path, raw):
    (tmp_path / "p.json").write_text(json.dumps(raw))
    with pytest.raises(ValueError, match="unknown"):
        config.load(tmp_path / "p.json")


def test_an_empty_file_gives_the_defaults(tmp_path):
    (tmp_path / "p.json").write_text("{}")
    assert config.load(tmp_path / "p.json") == config.Settings()
