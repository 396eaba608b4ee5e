"""permeate.plans"""
