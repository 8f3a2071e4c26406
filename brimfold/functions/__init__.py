"""brimfold.functions"""
