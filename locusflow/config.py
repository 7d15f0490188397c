"""Defaults of the public functions."""

from enum import Enum

MISSING_ALLELE = -1
MIN_NUM_SAMPLES = 20
POLY_THRESHOLD = 0.95
NUM_BINS = 40
HIST_RANGE = (0.0, 1.0)
VARS_PER_CHUNK = 10_000
POP_NAME = "pop"
MAX_LD_MEASURES = 10_000
CHROM_COL, POS_COL, QUAL_COL, ID_COL = "chrom", "pos", "qual", "id"
VAR_TABLE_CHROM_COL, VAR_TABLE_POS_COL = CHROM_COL, POS_COL


class BinType(Enum):
    LINEAL = "lineal"
    LOGARITHMIC = "logarithmic"


class LDCalcMethod(Enum):
    GENERATOR = "generator"
    MATRIX = "matrix"
