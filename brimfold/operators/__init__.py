"""brimfold.operators"""
