"""Documents to fine-tuning examples, as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

from inkweave.operators.chunking import chunk_documents, clean_documents
from inkweave.operators.quality import Evaluator, evaluate_dataset, quality_gate
from inkweave.operators.splits import split_examples
from inkweave.operators.statistics import statistics_report
from inkweave.operators.tasks import TaskTemplate, execute_tasks, python_runner
from inkweave.plans.process import process_documents, quick_process
from inkweave.sinks.export import export_dataset
from inkweave.sources.files import FileLoader, scan_directory
from inkweave.sources.load import load_documents, load_sources

# The few Python functions travel to the executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "Evaluator",
    "FileLoader",
    "TaskTemplate",
    "chunk_documents",
    "clean_documents",
    "evaluate_dataset",
    "execute_tasks",
    "export_dataset",
    "load_documents",
    "load_sources",
    "process_documents",
    "python_runner",
    "quality_gate",
    "quick_process",
    "scan_directory",
    "split_examples",
    "statistics_report",
]
