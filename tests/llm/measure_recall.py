"""Recall of the nearest-neighbour query against brute force: python tests/llm/measure_recall.py FOLDER."""

import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def main(folder: str) -> None:
    from pyspark.sql import SparkSession

    from claimloom.llm import ann

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    rows = ann.clean(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding").toPandas()
    found = ann.op10_nearest_neighbours(spark, folder).toPandas()
    x = np.array(rows["vector"].tolist())
    ids, unit = rows["id"].to_numpy(), x / np.linalg.norm(x, axis=1, keepdims=True)
    place = {v: i for i, v in enumerate(ids.tolist())}
    hit = 0
    for q, own in found.groupby("query_id"):
        cosine = unit @ unit[place[q]]
        cosine[place[q]] = -9
        hit += len(set(ids[np.lexsort((ids, -np.round(cosine, 12)))[:5]]) & set(own["vec_id"]))
    print(f"{len(ids)} vectors, {len(found)} rows, recall@5 {hit / len(found):.4f}")


if __name__ == "__main__":
    main(sys.argv[1])
