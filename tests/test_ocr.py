import numpy as np

from cohortlake.operators import ocr


def test_images():
    assert [x.shape for x in ocr.split_frames(np.zeros((2, 4, 5)))] == [(4, 5), (4, 5)]
    assert [x.shape for x in ocr.split_frames(np.zeros((4, 5, 3)))] == [(4, 5, 3)] and len(ocr.split_frames(np.zeros((7, 4, 5, 3)))) == 7
    image = np.array([[0, 100, 200]])
    assert ocr.windowed(image, {}) is image and ocr.windowed(image, {"0028,1053": "2", "0028,1052": "-1"}).tolist() == [[-1, 199, 399]]
    assert ocr.windowed(image, {"0028,1050": "100.5", "0028,1051": "101"}).tolist() == [[50, 100, 150]]
    assert ocr.grey(image).tolist() == [[0, 127, 255]] and ocr.grey(np.ones((2, 2))).sum() == 0


def test_regions_from_an_engine(spark):
    frames = spark.createDataFrame([("a", 4, 5, 1, 2, 8, 0, bytearray(range(40)))], "sop_instance_uid string, rows int, cols int, samples int, frames int, bits int, pixel_repr int, pixels binary")
    instances = spark.createDataFrame([("a", {"0010,0010": "x"})], "sop_instance_uid string, attributes map<string,string>")
    engine = lambda: lambda image: [(f"T{image.shape[0]}", 1, 2, 3, 4, 90.0), (" ", 0, 0, 1, 1, 90.0), ("low", 0, 0, 1, 1, 0.0)]
    got = ocr.text_regions(frames, instances, engine)
    assert [tuple(r) for r in got.orderBy("frame_index").collect()] == [("a", 0, "T4", 1, 2, 3, 4, 90.0), ("a", 1, "T4", 1, 2, 3, 4, 90.0)]
    assert ocr.joined_text(got).first().text == "T4 T4"
