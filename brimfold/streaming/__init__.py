"""brimfold.streaming"""
