"""brimfold.plans"""
