"""Small cohorts written out step by step, as for tests and examples."""

from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession

from ..plans import cohort as model


class CohortBuilder:
    """Each call adds to the last patient, study, series or instance; ``build`` makes the tables."""

    def __init__(self):
        self.rows: dict[str, list[list]] = {"patients": [], "studies": [], "series": [], "instances": [], "seq_items": []}

    def patient(self, patient_id: str, name: str) -> CohortBuilder:
        return self._add("patients", [patient_id, name])

    def study(self, uid: str, day: date | None, time: str | None = None) -> CohortBuilder:
        return self._add("studies", [uid, self._last("patients"), day, time, False])

    def series(self, uid: str, modality: str, number: int | None = None, manufacturer: str | None = None, model_name: str | None = None, serial: str | None = None) -> CohortBuilder:
        return self._add("series", [uid, self._last("studies"), modality, number, manufacturer, model_name, serial])

    def instance(self, uid: str, sop_class: str | None = None, number: int | None = None, **attributes: str) -> CohortBuilder:
        return self._add("instances", [uid, self._last("series"), sop_class, number, None, dict(attributes)])

    def attribute(self, tag: str, value: str) -> CohortBuilder:
        self._last("instances")
        self.rows["instances"][-1][-1][tag] = value
        return self

    def item(self, path: str, tag: str, vr: str, value: str) -> CohortBuilder:
        return self._add("seq_items", [self._last("instances"), path, tag, vr, value])

    def build(self, spark: SparkSession) -> model.Cohort:
        schemas = {"patients": model.PATIENTS, "studies": model.STUDIES, "series": model.SERIES, "instances": model.INSTANCES, "seq_items": model.SEQ_ITEMS}
        return model.Cohort(**{name: spark.createDataFrame([tuple(r) for r in self.rows[name]], schema) for name, schema in schemas.items()})

    def _add(self, table: str, row: list) -> CohortBuilder:
        self.rows[table].append(row)
        return self

    def _last(self, table: str) -> str:
        if not self.rows[table]:
            raise ValueError(f"there are no {table} yet")
        return self.rows[table][-1][0]
