import pytest

from hierfeat.spec import HierarchySpec, TableSpec, flag_name, mode_name


def test_names_follow_the_mode():
    assert mode_name("train_person_1", True) == "test_person_1"
    assert mode_name("train_person_1", False) == "train_person_1"
    assert flag_name("train_person_1") == flag_name("test_person_1.parquet") == "person_1_joined_flag"


def test_spec_for_inference():
    spec = HierarchySpec(
        (TableSpec("train_person_1", 1), TableSpec("train_person_2", 2, parent="train_person_1"))
    ).for_mode(True)
    assert spec.base == "test_base"
    assert [t.name for t in spec.tables] == ["test_person_1", "test_person_2"]
    assert spec.at_depth(2)[0].parent == "test_person_1"
    assert spec.at_depth(2)[0].order_columns == ("num_group2",)


def test_depth_2_needs_a_listed_parent():
    with pytest.raises(ValueError, match="needs its parent"):
        TableSpec("train_person_2", 2)
    with pytest.raises(ValueError, match="not a listed"):
        HierarchySpec((TableSpec("train_person_2", 2, parent="train_person_1"),))
    with pytest.raises(ValueError, match="depth"):
        TableSpec("x", 3)
