import pytest

EDGE = [None, "", " ", "　\n", "a", "同", "x" * 50_000, "长" * 30_000, "重复的文本。", "重复的文本。", "a\0b 字😀"]


@pytest.fixture
def edge_texts():
    return [t.encode("utf-16", "surrogatepass").decode("utf-16") if t else t for t in EDGE]
