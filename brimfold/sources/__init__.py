"""brimfold.sources"""
