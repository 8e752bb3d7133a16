import codeloom
import pytest


@pytest.mark.parametrize("name", codeloom.__all__)
def test_public_names(name):
    assert getattr(codeloom, name) is not None


def test_unknown_name():
    with pytest.raises(AttributeError):
        codeloom.nothing
