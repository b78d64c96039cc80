"""Held-out figures for classifier tests."""

import numpy as np


def auc(label, score):
    label, score = np.asarray(label), np.asarray(score)
    rank = np.array([(score < s).sum() + (score == s).sum() / 2 for s in score])
    ones = (label == 1).sum()
    return (rank[label == 1].sum() - ones * ones / 2) / (ones * (len(label) - ones))
