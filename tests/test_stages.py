"""Stage tables follow their input tables."""

from quarry.plans import stages
from quarry.sources.incidents import TABLES
from quarry.sources.tables import load_table, table_path, table_state

SF = "/root/testdata/sf0.001"


def test_a_table_written_again_is_a_new_stage(spark, tmp_path):
    folder = str(tmp_path)
    for t in TABLES:
        load_table(spark, SF, t).write.parquet(table_path(folder, t))
    first = stages.raw(spark, folder)
    before, rows = table_state(spark, folder, TABLES), first.count()
    assert stages.raw(spark, folder).inputFiles() == first.inputFiles()  # nothing changed: the same files
    load_table(spark, SF, "events").where("event_id % 2 = 0").write.mode("overwrite").parquet(table_path(folder, "events"))
    again = stages.raw(spark, folder)
    assert table_state(spark, folder, TABLES) != before
    assert again.count() < rows and first.count() == rows  # earlier readers keep theirs
    assert stages.processed(spark, folder).count() < stages.processed(spark, SF).count()


def test_state_of_one_file_and_of_a_folder(spark, tmp_path):
    folder = str(tmp_path)
    load_table(spark, SF, "nation").repartition(3).write.parquet(table_path(folder, "nation"))
    (path, _, size, files), = table_state(spark, folder, ["nation"])
    assert path.endswith("nation.parquet") and size > 0 and files >= 3
    (_, _, one, count), = table_state(spark, SF, ["nation"])
    assert one == 2559 and count == 1
