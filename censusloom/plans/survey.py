"""The developer-survey analysis, composed of the library's table jobs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censusloom.functions.scalars import (
    bounded_ratio,
    floored_difference,
    label_score,
    mask_allocation,
    number,
    years_to_number,
)
from censusloom.modeling import ModelSpec
from censusloom.operators import associations, charts, cleaning, distributions, profiling
from censusloom.operators.layout import ROWS_PER_BUCKET, fit_layout
from censusloom.plans import facts
from censusloom.plans import survey_schema as schema
from censusloom.sources.contracts import require_columns, require_domain, require_population, require_rows
from censusloom.sources.files import scratch_folder, write_table


RESULT_TABLES = (
    "raw_dataset_overview",
    "raw_column_profile",
    "raw_salary_summary",
    "data_quality",
    "cleaned_salary_data",
    "cleaned_descriptive_statistics",
    "cleaned_column_profile",
    "numeric_correlation_top",
    "numeric_correlation_matrix",
    "categorical_salary_summary",
    "ordinal_income_spearman",
    "ordinal_income_trends",
    "categorical_income_associations",
    "employment_income_effects",
    "remote_salary_test",
    "salary_histogram",
    "salary_density",
    "log_salary_density",
    "experience_line",
    "experience_sample",
    "headline_facts",
)


def allowed_labels() -> dict[str, list[str]]:
    """Labels every scored question may hold, declined answers included."""
    likert = {name: list(schema.LIKERT_SCORES) for name in schema.KNOWLEDGE}
    ordinal = {
        name: [*levels, *declined] for name, (_, levels, declined) in schema.ORDINAL_QUESTIONS.items()
    }
    return {**likert, **ordinal}


def check_input(df: DataFrame) -> None:
    """Columns, rows and labels the analysis relies on."""
    require_columns(df, schema.REQUIRED_COLUMNS)
    require_rows(df)
    require_domain(df, allowed_labels())


def derive(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Deduplicate and add all scores and experience columns in one projection.

    ``order`` decides which row of a repeated key stays; all columns by default.
    """
    unique = cleaning.first_per_key(df, [schema.KEY], list(order or sorted(df.columns)))
    coding = years_to_number(F.col("YearsCode").cast("string"), schema.YEAR_BOUNDARIES)
    professional = years_to_number(F.col("YearsCodePro").cast("string"), schema.YEAR_BOUNDARIES)
    work = number(unique, "WorkExp")
    added = {
        "YearsCode_num": coding,
        "YearsCodePro_num": professional,
        "WorkExp_num": work,
        "ProfessionalExperienceRatio": bounded_ratio(professional, coding),
        "PreProfessionalCodingYears": floored_difference(coding, professional),
        "WorkProfessionalGapYears": work - professional,
        schema.TARGET: number(unique, schema.TARGET),
    }
    for name in schema.KNOWLEDGE:
        added[f"{name}_score"] = label_score(F.col(name), schema.LIKERT_SCORES)
    for name, (_, levels, _) in schema.ORDINAL_QUESTIONS.items():
        added[f"{name}_order"] = label_score(F.col(name), {label: i for i, label in enumerate(levels)})
    return unique.withColumns(added)


def clean(
    raw: DataFrame, derived: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET
) -> tuple[DataFrame, DataFrame]:
    """The analysis population (1 % trimmed on both ends) and its quality report."""
    trimmed, low, high = cleaning.quantile_trim(derived, schema.TARGET, rows_per_bucket=rows_per_bucket)
    table = trimmed.withColumn(schema.LOG_TARGET, F.log1p(schema.TARGET))
    report = cleaning.quality_report(raw, derived, table, [schema.KEY], schema.TARGET, low, high)
    return table, report


def model_population(derived: DataFrame, min_rows: int = 100) -> DataFrame:
    """The modelling population: valid targets, untrimmed, so the holdout leaks nothing."""
    rows = cleaning.valid_target(derived, schema.TARGET)
    require_population(fit_layout(rows, schema.TARGET).rows, min_rows, "the model population")
    return rows


def correlation_matrix(cleaned: DataFrame) -> DataFrame:
    """The 23-variable Pearson matrix, points that do not add up to 100 left out."""
    require_columns(cleaned, schema.MATRIX_COLUMNS)
    numbers = cleaned.select(*[number(cleaned, name).alias(name) for name in schema.MATRIX_COLUMNS])
    masked = mask_allocation(numbers, schema.POINT_COLUMNS)
    return associations.pearson_matrix(masked, schema.MATRIX_COLUMNS, schema.MATRIX_LABELS)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared scratch folder and read back."""
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class SurveyAnalysis:
    """All descriptive and inferential tables of the survey, each built when asked for.

    ``derived`` feeds every table. ``settle`` writes it and the cleaned table once to the
    folder all executors share, so that no result table derives, deduplicates and trims
    again; without it, persist ``derived`` before writing many of them.
    """

    def __init__(
        self,
        raw: DataFrame,
        derived: DataFrame,
        min_group_size: int = 20,
        rows_per_bucket: int = ROWS_PER_BUCKET,
        settle: bool = False,
    ):
        self.raw = raw
        self.min_group_size = min_group_size
        self.rows_per_bucket = rows_per_bucket
        self.table, self.data_quality = clean(raw, settled(derived) if settle else derived, rows_per_bucket)
        if settle:
            self.table = settled(self.table)

    @cached_property
    def raw_dataset_overview(self) -> DataFrame:
        return profiling.dataset_overview(self.raw, [schema.KEY], schema.TARGET)

    @cached_property
    def raw_column_profile(self) -> DataFrame:
        return profiling.column_profile(self.raw)

    @cached_property
    def raw_salary_summary(self) -> DataFrame:
        return profiling.target_summary(self.raw, schema.TARGET, rows_per_bucket=self.rows_per_bucket)

    @cached_property
    def cleaned_salary_data(self) -> DataFrame:
        return self.table.select(*schema.CLEANED_COLUMNS)

    @cached_property
    def cleaned_descriptive_statistics(self) -> DataFrame:
        return profiling.describe_columns(
            self.table, schema.DESCRIBED_COLUMNS, rows_per_bucket=self.rows_per_bucket
        )

    @cached_property
    def cleaned_column_profile(self) -> DataFrame:
        columns = [*schema.DESCRIBED_COLUMNS, *schema.CATEGORY_FEATURES]
        return profiling.column_profile(self.table, columns)

    @cached_property
    def numeric_correlation_top(self) -> DataFrame:
        return associations.pearson_with_target(
            self.table, schema.NUMERIC_CANDIDATES, schema.LOG_TARGET, top_n=3
        )

    @cached_property
    def numeric_correlation_matrix(self) -> DataFrame:
        return correlation_matrix(self.table)

    @cached_property
    def numeric_correlation_table(self) -> DataFrame:
        """The matrix in wide form: one row and one column per variable, in the usual order."""
        return associations.matrix_table(self.numeric_correlation_matrix, list(schema.MATRIX_LABELS.values()))

    @cached_property
    def categorical_salary_summary(self) -> DataFrame:
        return distributions.category_distribution(
            self.table, schema.CATEGORY_FEATURES, schema.TARGET, self.min_group_size, self.rows_per_bucket
        )

    @cached_property
    def ordinal_income_spearman(self) -> DataFrame:
        labels = {f"{name}_order": label for name, (label, _, _) in schema.ORDINAL_QUESTIONS.items()}
        return associations.spearman_with_target(
            self.table, labels, schema.LOG_TARGET, self.rows_per_bucket
        )

    @cached_property
    def ordinal_income_trends(self) -> DataFrame:
        levels = {
            f"{name}_order": (label, dict(enumerate(texts)))
            for name, (label, texts, _) in schema.ORDINAL_QUESTIONS.items()
        }
        return distributions.ordinal_trend(
            self.table, levels, schema.TARGET, self.min_group_size, self.rows_per_bucket
        )

    @cached_property
    def categorical_income_associations(self) -> DataFrame:
        return associations.nominal_associations(
            self.table, schema.NOMINAL_FEATURES, schema.LOG_TARGET, self.min_group_size, self.rows_per_bucket
        )

    @cached_property
    def employment_income_effects(self) -> DataFrame:
        return associations.multiselect_tests(
            self.table,
            schema.EMPLOYMENT,
            schema.TARGET,
            schema.LOG_TARGET,
            self.min_group_size,
            self.rows_per_bucket,
        )

    @cached_property
    def remote_salary_test(self) -> DataFrame:
        return associations.welch_test(
            self.table, schema.REMOTE_COLUMN, schema.REMOTE, schema.IN_PERSON, schema.LOG_TARGET
        )

    @cached_property
    def salary_histogram(self) -> DataFrame:
        return charts.histogram(self.table, [schema.TARGET, schema.LOG_TARGET])

    @cached_property
    def salary_density(self) -> DataFrame:
        return charts.density_curve(self.table, schema.TARGET)

    @cached_property
    def log_salary_density(self) -> DataFrame:
        return charts.density_curve(self.table, schema.LOG_TARGET)

    @cached_property
    def _experience(self) -> DataFrame:
        return self.table.select(schema.KEY, "YearsCodePro_num", schema.TARGET).dropna()

    @cached_property
    def experience_line(self) -> DataFrame:
        return charts.regression_line(self._experience, "YearsCodePro_num", schema.TARGET)

    @cached_property
    def experience_sample(self) -> DataFrame:
        return charts.fixed_sample(self._experience, schema.KEY)

    @cached_property
    def level_facts(self) -> DataFrame:
        """Rates, levels, top categories and the remote ratio."""
        return facts.fact_table(
            [
                facts.cleaning_facts(self.data_quality),
                facts.level_facts(self.cleaned_descriptive_statistics, schema.TARGET),
                facts.category_facts(self.categorical_salary_summary, schema.TOP_CATEGORY_FEATURES),
                facts.group_ratio_fact(self.remote_salary_test),
            ]
        )

    @cached_property
    def strongest_facts(self) -> DataFrame:
        """The strongest feature of every association table."""
        strongest = facts.strongest_fact
        return facts.fact_table(
            [
                strongest(self.numeric_correlation_top, "strongest_numeric", "feature", "pearson_r"),
                strongest(self.ordinal_income_spearman, "strongest_ordinal", "feature", "spearman_rho"),
                strongest(self.categorical_income_associations, "strongest_nominal", "feature", "eta_squared"),
                strongest(self.employment_income_effects, "strongest_option", "option", "point_biserial_r"),
            ]
        )

    @cached_property
    def headline_facts(self) -> DataFrame:
        return self.level_facts.unionByName(self.strongest_facts)

    def write(self, folder: str, kind: str = "csv", names: Sequence[str] = RESULT_TABLES) -> None:
        """Write the named tables below ``folder``."""
        for name in names:
            write_table(getattr(self, name), f"{folder.rstrip('/')}/{name}", kind=kind)


def model_spec(**changes) -> ModelSpec:
    """The survey's training job; ``changes`` override single settings."""
    settings = {
        "target": schema.TARGET,
        "key": schema.KEY,
        "numeric": schema.MODEL_NUMERIC,
        "nominal": schema.MODEL_NOMINAL,
        "multiselect": schema.MODEL_MULTISELECT,
    }
    return ModelSpec(**{**settings, **changes})
