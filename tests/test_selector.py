import pytest

from meshweave.functions import selector

ROWS = [(i, float(i % 5), float(i // 5), 0.0, [["inlet"], ["wall"], ["wall", "hot"], []][i % 4], [i % 3] if i % 4 else [], 0.0, 0.0, 1.0 if i % 2 else -1.0) for i in range(25)]


@pytest.fixture(scope="module")
def elements(spark):
    return spark.createDataFrame(ROWS, "lnum int, x double, y double, z double, groups array<string>, attributes array<int>, nx double, ny double, nz double").cache()


CASES = {
    "all[]": lambda r: True,
    "no_group[]": lambda r: not r[4] and not r[5],
    "inlet": lambda r: "inlet" in r[4],
    "wall and not hot": lambda r: "wall" in r[4] and "hot" not in r[4],
    "wall && ! hot": lambda r: "wall" in r[4] and "hot" not in r[4],
    "inlet, hot; 2": lambda r: "inlet" in r[4] or "hot" in r[4] or 2 in r[5],
    "(inlet or wall) and x <= 2": lambda r: ("inlet" in r[4] or "wall" in r[4]) and r[1] <= 2,
    "wall ^ y > 2": lambda r: ("wall" in r[4]) != (r[2] > 2),
    "3 < x": lambda r: r[1] > 3,
    "range[1, 2]": lambda r: any(1 <= a <= 2 for a in r[5]),
    "range[hot, inlet, group]": lambda r: any("hot" <= g <= "inlet" for g in r[4]),
    "box[1, 1, 0, 3, 2, 0]": lambda r: 1 <= r[1] <= 3 and 1 <= r[2] <= 2,
    "box[0, 0, -1, 2, 2, 0, -2, 2, 0, 0, 0, 2]": lambda r: 0 <= 2 * r[1] + 2 * r[2] <= 8 and 0 <= -2 * r[1] + 2 * r[2] <= 8,
    "sphere[2, 2, 0, 1.5]": lambda r: (r[1] - 2) ** 2 + (r[2] - 2) ** 2 <= 2.25,
    "cylinder[0, 2, 0, 3, 2, 0, 1]": lambda r: 0 <= r[1] <= 3 and (r[2] - 2) ** 2 <= 1,
    "plane[1, 0, 0, -2, inside]": lambda r: r[1] <= 2,
    "plane[1, 0, 0, -2, outside]": lambda r: r[1] >= 2,
    "plane[2, 0, 0, 3, 0, 0, epsilon=0.1]": lambda r: abs(r[1] - 3) < 0.1,
    "normal[0, 0, 2]": lambda r: r[8] > 0,
    '"inlet"': lambda r: "inlet" in r[4],
    r"\wall": lambda r: "wall" in r[4],
}


@pytest.mark.parametrize("text", CASES)
def test_selections(elements, text):
    assert sorted(r.lnum for r in selector.select(elements, text).collect()) == [r[0] for r in ROWS if CASES[text](r)]


@pytest.mark.parametrize("text", ["", "and", "(wall", "wall)", "x <", "wall hot", "1 < 2", "box["])
def test_errors(spark, text):
    with pytest.raises((selector.SelectionError, ValueError)):
        selector.parsed(text)


def test_needs_and_missing(elements):
    with pytest.raises(selector.SelectionError):
        selector.select(elements.drop("nx"), "normal[0,0,1]")
    assert selector.missing_operands(elements, "wall or roof or 2 or 9") == ["roof", "9"]
    assert selector.parsed("x < 2").needs_coordinates and not selector.parsed("wall").needs_coordinates


@pytest.mark.parametrize("text", ["range[]", "sphere[1]", "box[1, 2]", "plane[0, 0, 0, 1]", "cylinder[1]", "normal[0]", "range[1, 2, 3]"])
def test_wrong_arguments(text):
    with pytest.raises(selector.SelectionError):
        selector.parsed(text)
