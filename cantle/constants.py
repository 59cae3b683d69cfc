"""Fixed values of the token space and the codec."""

DIRECTIONS = 720
PAD, SEP, EOS, BOS, INNER, SCALE_5000, SCALE_10000 = range(720, 727)
SPECIAL = tuple(range(PAD, SCALE_10000 + 1))
BPE_START, BPE_SIZE, BPE_MAX_ATOMS = 1500, 6000, 10
STEP_M = 0.2
SEED = 20260713
SPLIT_FRACTION, RECTANGLE_FRACTION = 0.8, 0.1
BPE_ROWS, DIAGNOSTIC_ROWS = 10_000, 512
EPSG = {32611: 11, 32618: 18}
